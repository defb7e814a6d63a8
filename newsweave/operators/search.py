"""The keyword search over feeds and pages, without storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.constants import REPORT_DATE, REPORT_LINE, REPORT_LINK, REPORT_SUMMARY
from newsweave.functions import dates, html, text, urls
from newsweave.sources.places import kept

from . import sentences
from .dedup import fuzzy_first
from .numbering import numbered

LEAST_TOKENS = 10


def candidates(entries: DataFrame, keywords: Sequence[str], days: int, as_of: Column, own_zone: bool = False) -> DataFrame:
    """Entries with title, resolved link and readable date, fresh enough, with a keyword in the title; `own_zone`: and `shown`, the date in its own zone."""
    words = [k.lower() for k in text.expand_keywords(keywords)]
    # titles first: they are cheap and leave few entries whose links and dates are read
    titled = entries.withColumn("title", text.strip(F.col("title"))).filter("title <> ''").filter(text.contains_any(F.lower("title"), text.literals(words)))
    read = F.struct(urls.resolved(F.col("link")).alias("link"), dates.parsed(F.col("published"), as_of).alias("published"), *([dates.as_written(F.col("published"), as_of).alias("shown")] if own_zone else []))
    # generated, so they are read once an entry and not in the filters as well, which would go below the joins that make the entries
    made = titled.select("feed_ord", "entry_ord", "title", F.inline(F.array(read)))
    return made.filter("link <> ''").filter(F.col("published") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def search_news(entries: DataFrame, pages: DataFrame, keywords: Sequence[str], days: int, as_of: Column, model: sentences.Model | None = None, own_zone: bool = False) -> DataFrame:
    """n, title, published, link, summary of the found articles, in feed order.

    Near-copies of earlier titles go before pages are looked at, so an article whose page fails still hides its copies.
    `pages`: url, html. A page whose description has under ten tokens, or none, gives no row. With a learnt `model` abbreviations
    do not end the sentences of a summary. Times are in UTC, with `own_zone` as the entry has them.
    """
    first = fuzzy_first(candidates(entries, keywords, days, as_of, own_zone))
    # pages are taken apart once each, and what is numbered is sorted without them
    own = pages.select(F.col("url").alias("link"), "html").join(first.select("link"), "link", "left_semi")
    described = own.select("link", (html.snippet("html") if model is None else sentences.summarised(html.description("html"), model)).alias("summary"))
    found = kept(first.join(described, "link"), "found").filter(text.token_count(F.col("summary")) >= LEAST_TOKENS)
    listed = numbered(found, "n", F.col("feed_ord"), F.col("entry_ord"))
    return listed.select("n", "title", F.date_format("shown" if own_zone else "published", "yyyy-MM-dd HH:mm").alias("published"), "link", "summary")


def report(found: DataFrame) -> DataFrame:
    """One text line block for each article."""
    return found.select("n", F.concat(F.col("n"), F.lit(". "), F.col("title"), F.lit("\n"), F.col("published"), F.lit("\n"), F.col("link"), F.lit("\n"), F.col("summary")).alias("entry"))


def labelled_report(found: DataFrame) -> DataFrame:
    """The same with its labels and a line after each article."""
    lines = [F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("title")), *[F.concat(F.lit(label), F.col(c)) for label, c in ((REPORT_DATE, "published"), (REPORT_LINK, "link"), (REPORT_SUMMARY, "summary"))], F.lit(REPORT_LINE)]
    return found.select("n", F.array_join(F.array(*lines), "\n").alias("entry"))
