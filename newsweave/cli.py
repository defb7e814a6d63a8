"""Keyword search from the command line: python -m newsweave.cli --keywords "sebs, MERS" --feeds a.xml b.xml --pages pages.parquet"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsweave.operators import search
from newsweave.sources import feeds


def options(args: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Search feeds for keywords or named keyword sets.")
    parser.add_argument("--keywords", required=True, help="comma-separated keywords or names of sets")
    parser.add_argument("--days", type=int, default=3, help="oldest article, in days")
    parser.add_argument("--feeds", nargs="+", required=True, help="feed files in order")
    parser.add_argument("--pages", required=True, help="Parquet table of url, html")
    parser.add_argument("--as-of", type=datetime.fromisoformat, help="reference time in UTC; now by default")
    parser.add_argument("--labels", action="store_true", help="label the lines of an article and show its date in its own zone")
    chosen = parser.parse_args(args)
    chosen.keywords = [k.strip() for k in chosen.keywords.split(",") if k.strip()]
    return chosen


def run(spark: SparkSession, chosen: argparse.Namespace) -> int:
    """Print the found articles; gives their number."""
    entries = feeds.read_feeds(spark, chosen.feeds).withColumn("published", F.col("published_text"))
    now = F.lit(chosen.as_of or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
    found = search.search_news(entries, spark.read.parquet(chosen.pages), chosen.keywords, chosen.days, now, own_zone=chosen.labels)
    found = search.labelled_report(found) if chosen.labels else search.report(found)
    n = 0
    for row in found.orderBy("n").toLocalIterator():
        print(row.entry)
        n += 1
    return n


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), options())
