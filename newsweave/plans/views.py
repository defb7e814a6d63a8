"""The driver's tables seen as feed entries, pages, cases and articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS, EXCLUDED, ALERTS = ["ung", "ment", "tion"], ["que"], ["heit", "the"]
TRUSTED = ["example.net", "example.org"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Documents as entries: four share a page's link; `as_of` is the newest entry's date.

    Dates and links come by document first, so texts meet them in one exchange. `of` makes columns of feed_ord, entry_ord, title and
    summary before that, so a text that only serves to make them is in none.
    """
    # the event of document k is 5 k
    events = table(spark, sf_dir, "events").filter("event_id % 5 = 0").select(F.expr("event_id div 5").alias("entry_ord"), F.col("ts").alias("published"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("link"), "html")
    placed = events.join(pages, F.floor(F.col("entry_ord") / 4) == F.col("page_id")).drop("page_id")
    docs = table(spark, sf_dir, "documents")
    newest = docs.select(F.col("doc_id").alias("entry_ord")).join(placed.select("entry_ord", "published"), "entry_ord").agg(F.max("published").alias("as_of"))
    made = of(docs.select((F.col("doc_id") % 11).cast("int").alias("feed_ord"), F.col("doc_id").alias("entry_ord"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("summary")))
    own = [c for c in made.columns if c not in ("feed_ord", "entry_ord", "title", "summary")]
    full = made.join(placed, "entry_ord").select("feed_ord", "entry_ord", "link", "title", *[c for c in made.columns if c == "summary"], "published", "html", *own)
    return full.join(F.broadcast(newest), F.lit(True))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as disease cases; `as_of` is the newest one's date."""
    events = table(spark, sf_dir, "events")
    made = events.select(F.col("event_id").alias("article_id"), F.col("event_type").alias("disease_name"), F.floor("value").cast("long").alias("case_count"), F.col("ts").alias("report_date"))
    return made.join(F.broadcast(made.agg(F.max("report_date").alias("as_of"))), F.lit(True))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.select(F.col("entry_ord").alias("id"), "title", "link", F.col("published").alias("published_date"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of two entries in three."""
    from newsweave.functions import text, urls

    e = entries(spark, sf_dir, lambda rows: rows.filter("entry_ord % 3 <> 0").withColumn("summary", text.truncated(F.col("summary"))))
    return e.select(F.col("entry_ord").alias("article_id"), "summary", urls.domain(F.col("link")).alias("source"), text.match_keywords(F.col("title"), KEYWORDS, EXCLUDED).alias("keywords_matched"), text.tags(F.col("title"), F.col("published"), F.col("as_of"), ALERTS).alias("tags"), (F.col("entry_ord") % 2 == 0).alias("is_whitelisted"))
