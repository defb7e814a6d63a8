"""Connected components of an edge table by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, shared_path, until_exit


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges`: a, b (bigint). Returns node, root for every node on an edge; root is the component's least node.

    Each round links every node's larger neighbours to its least one (large star), then its smaller ones (small
    star), until the edges are stars. A round's edges are written and the last round's deleted; a hub's neighbours are only ever aggregated,
    never gathered. An empty table gives no rows; null ends and loops are ignored.
    """
    cols = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "components")
        df.write.parquet(path)
        until_exit(spark, path)
        return spark.read.schema("hi bigint, lo bigint").parquet(path), path

    now, path = written(edges.filter("a is not null and b is not null and a <> b").select(*cols).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        last, (now, path) = path, written(small)
        removed(spark, last)
        mark = now.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
