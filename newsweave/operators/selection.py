"""Choosing rows of a result: toggled lists, chosen links, removal by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggled(chosen: Column, item: Column) -> Column:
    """The list without the item if it holds it, else with it at the end."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.array_append(chosen, item))


def picked(rows: DataFrame, chosen: DataFrame, key: str = "link") -> DataFrame:
    """The rows whose key was chosen."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, id_: int) -> DataFrame:
    return rows.filter(F.col("id") != id_)


def tally(rows: DataFrame, chosen: DataFrame, key: str = "link") -> DataFrame:
    """found, chosen: how many rows there are and how many were picked."""
    marks = chosen.select(key).distinct().withColumn("_on", F.lit(True))
    return rows.join(marks, key, "left").agg(F.count("*").alias("found"), F.count("_on").alias("chosen"))
