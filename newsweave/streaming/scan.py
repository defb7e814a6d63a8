"""Incremental scans: feed entries as a file stream, one scan for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsweave.operators.scan import ScanOptions, route
from newsweave.schemas import ENTRY
from newsweave.sources.store import Store


def entry_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Entries from Parquet files that arrive in a folder."""
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_at_once).parquet(path)


def scan_stream(entries: DataFrame, store: Store, as_of: Callable[[], Column], checkpoint: str, options: ScanOptions | None = None) -> StreamingQuery:
    """Scan what has arrived and stop. A batch is stored as one commit and links of stored articles are not stored again, so a batch
    that failed or is repeated does no harm."""

    def scan(batch: DataFrame, _: int) -> None:
        now = as_of()
        routed = route(batch, store.keywords(), store.domains(), store.read("article_identity"), now, options)
        store.save_scan(routed, now)

    return entries.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful_scan_stream(entries: DataFrame, store: Store, as_of: Callable[[], Column], checkpoint: str, name: str = "scan", remember: str = "30 days", options: ScanOptions | None = None) -> StreamingQuery:
    """The same without reading stored links: the stream's own state, keyed by link, lets the first entry of a link through.

    A link is remembered until entries `remember` later than it have come (an entry without a date counts as of now); entries older than that are
    dropped; which of several entries of one batch comes through is not fixed. The store keeps the number of the last batch with its commit, so a batch that is repeated after a failure is stored once. Links that came by
    other ways than this stream are not known to it.
    """
    timed = entries.withColumn("_at", F.coalesce(F.col("published").cast("timestamp"), F.current_timestamp())).withWatermark("_at", remember)
    once = timed.filter(F.col("link") != "").dropDuplicatesWithinWatermark(["link"]).drop("_at")

    def scan(batch: DataFrame, number: int) -> None:
        now = as_of()
        store.save_scan(route(batch, store.keywords(), store.domains(), None, now, options), now, batch=(name, number))

    return once.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def links_by_hour(entries: DataFrame, late: str = "2 hours") -> DataFrame:
    """Distinct new links by hour of publication, late ones within the watermark."""
    timed = entries.withColumn("at", F.col("published").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["link"]).groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("links"))
