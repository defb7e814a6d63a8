"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.sources.places import kept

#: keys with more than one row in this many are heavy, so there are fewer heavy keys than this
SHARE = 10_000


def with_counts(rows: DataFrame, key: str, name: str, share: int = SHARE) -> DataFrame:
    """Rows with the number of rows that share their key (null keys go).

    Rows of heavy keys stay where they are and meet a broadcast of fewer than `share` counts; the others meet theirs in a shuffle in which
    no key has more than one row in `share`. `rows` is read three times.
    """
    counts = kept(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)), "counts")
    total = counts.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]
    heavy = counts.filter(F.col(name) * share > total)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return light.join(counts.filter(F.col(name) * share <= total), key).unionByName(rows.join(F.broadcast(heavy), key))
