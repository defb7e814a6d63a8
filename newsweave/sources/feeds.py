"""Feed files and pages as frames. Fetching over HTTP is an outside step that lands XML on storage."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions import dates, text
from newsweave.operators.numbering import numbered

ITEM = "link string, title string, summary string, description string, pubDate string, published string, updated string, _corrupt_record string"

PLACE = ("_file", "_block", "_row")


def _located(spark: SparkSession, paths: Sequence[str]) -> list[tuple[int, str, str]]:
    """(feed_ord, full path, the same as file names spell it) of what each path, pattern or folder names."""
    out, conf = [], spark._jsc.hadoopConfiguration()
    for nth, path in enumerate(paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        found = [s.getPath() for s in fs.globStatus(target) or []] if set(path) & set("*?[{") else [target]
        full = [fs.makeQualified(p) for p in found]
        out += [(nth, p.toString(), re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", p.toUri().toString()).rstrip("/")) for p in full]
    return out


def _entries(rows: DataFrame) -> DataFrame:
    """Records of a feed's files as entries, without their order."""
    bad = F.col("_corrupt_record").isNotNull() | F.coalesce("link", "title").isNull()
    when = F.coalesce("pubDate", "published", "updated")
    # `file:///a` and `file:/a` are one
    file = F.regexp_replace("_metadata.file_path", "^([A-Za-z0-9+.-]+):///", "$1:/")
    place = [file.alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1])]
    place += [] if rows.isStreaming else [F.monotonically_increasing_id().alias(PLACE[2])]
    made = rows.select(text.strip(F.col("link")).alias("link"), "title", "summary", "description", when.alias("published_text"), bad.alias("malformed"), *place)
    return made.withColumn("published", dates.parsed(F.col("published_text")))


def read_feeds(spark: SparkSession, paths: Sequence[str], row_tag: str = "item") -> DataFrame:
    """The entries of all feeds, in one scan; a feed's place in `paths` is its order (`row_tag="entry"` for Atom).

    A path is a file, a folder or a pattern; one that stands twice is two feeds. Entries are numbered within their feed by file and place in
    the file, whatever order Spark reads them in; broken ones are kept and marked. A path without records gives no rows.
    """
    located = _located(spark, paths)
    if not located:
        return _entries(spark.createDataFrame([], ITEM).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_block_start")))).select(F.lit(0).alias("feed_ord"), F.lit(0).cast("long").alias("entry_ord"), "*").drop(*PLACE)
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).schema(ITEM).load(sorted({p for _, p, _ in located}))
    feeds = spark.createDataFrame([(n, spelt) for n, _, spelt in located], "feed_ord int, _feed string")
    # a file belongs to the feeds that name it or one of its folders
    above = F.expr(f"transform(sequence(1, size(split({PLACE[0]}, '/'))), i -> substring_index({PLACE[0]}, '/', i))")
    owned = _entries(rows).withColumn("_feed", F.explode(above)).join(feeds, "_feed").drop("_feed")
    placed = numbered(owned, "_n", F.col("feed_ord"), *[F.col(c) for c in PLACE])
    first = placed.groupBy("feed_ord").agg(F.min("_n").alias("_first"))
    made = placed.join(first, "feed_ord").withColumn("entry_ord", F.col("_n") - F.col("_first"))
    return made.select("feed_ord", "link", "title", "summary", "description", "published_text", "malformed", "entry_ord", "published")


def read_feed(spark: SparkSession, path: str, feed_ord: int, row_tag: str = "item") -> DataFrame:
    """The entries of one feed."""
    return read_feeds(spark, [path], row_tag).withColumn("feed_ord", F.lit(feed_ord))


def feed_stream(spark: SparkSession, path: str, row_tag: str = "item", files_at_once: int = 1000) -> DataFrame:
    """Entries of feed files as they arrive below `path` (a folder or pattern), as a stream: feed (the file's folder) and the entry's columns, without an order."""
    rows = spark.readStream.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_at_once).schema(ITEM).load(path)
    made = _entries(rows)
    return made.withColumn("feed", F.regexp_extract(PLACE[0], "([^/]*)/[^/]*$", 1)).drop(*PLACE)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store, with the driver that the cluster provides."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
