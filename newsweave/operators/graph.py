"""Graphs held as edge tables: connected components, and the greedy choice of nodes in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.sources.places import drop, kept

#: components with more edges are settled in rounds over all tasks instead of in one task each
MOST_EDGES = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) for every node on an edge. `edges`: a, b (bigint); loops and null ends are ignored.

    Stars are contracted in turns: larger neighbours move to the least one around a node, then smaller ones, until all edges
    are stars. The rounds grow with the logarithm of a chain's length; a hub's neighbours are only ever aggregated.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        last, now = now, kept(small, "edges")
        drop(last)
        mark = now.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("lo").alias("node")).distinct()
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def walked(edges: Iterator[tuple[int, int, int]]) -> Iterator[int]:
    """The nodes dropped, from (root, a, b) in ascending order: all edges of a node to earlier ones come before its own."""
    root, dropped = None, set()
    for r, a, b in edges:
        if r != root:
            yield from dropped
            root, dropped = r, set()
        if a not in dropped:
            dropped.add(b)
    yield from dropped


def _walk(batches):
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    held: list[int] = []
    for node in walked(rows):
        held.append(node)
        if len(held) == 65_536:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["id"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["id"])


def _in_rounds(edges: DataFrame) -> DataFrame:
    """The same for any size of component: nodes without an open earlier neighbour stay, their later neighbours go, and so on."""
    out = []
    while not edges.isEmpty():
        stay = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        gone = kept(edges.join(stay.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        out.append(gone)
        rest = edges.join(gone.unionByName(stay).withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        edges = kept(rest, "edges")
    done = out[0]
    for frame in out[1:]:
        done = done.unionByName(frame)
    return done


def greedy_drops(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """id of the nodes that go when all are taken in ascending order and each goes if a node before it that stayed is linked to it.

    `edges`: a, b (bigint, a < b). What becomes of a node depends on its component only: a component is walked in order by one
    task that holds nothing but the nodes it has dropped, one with more than `most_edges` edges in rounds.
    """
    spark = edges.sparkSession
    edges = kept(edges, "pairs")
    n = edges.count()
    if not n:
        return spark.createDataFrame([], "id bigint")
    if n <= most_edges:  # no more than one component may have: walked as one
        return edges.select(F.lit(0).cast("long").alias("root"), "a", "b").repartition(1).sortWithinPartitions("root", "a", "b").mapInArrow(_walk, "id bigint")
    rooted = kept(edges.join(components(edges).withColumnRenamed("node", "a"), "a").select("root", "a", "b"), "rooted")
    large = rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most_edges).select("root")
    if large.isEmpty():
        return rooted.repartition("root").sortWithinPartitions("root", "a", "b").mapInArrow(_walk, "id bigint")
    small = rooted.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "a", "b").mapInArrow(_walk, "id bigint")
    return small.unionByName(_in_rounds(kept(rooted.join(large, "root", "left_semi").select("a", "b"), "edges")))
