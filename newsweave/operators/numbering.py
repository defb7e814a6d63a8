"""Running numbers over all rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsweave.sources.places import cut


def numbered(rows: DataFrame, name: str, *order: Column, after: int = 0) -> DataFrame:
    """Rows with `name` counting up from `after` + 1 in the given order.

    The rows are sorted by ranges and kept; each range numbers its own rows and adds the sizes of the ranges before it.
    Only those sizes, one a partition, are summed in one place. Ties are numbered in an arbitrary but fixed order.
    """
    placed = cut(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    # the high bits of _at are the partition, the low bits the place in it
    own = placed.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + F.lit(after + 1)).cast("long"))
    return own.drop("_part", "_at", "_base")
