"""The web scan: entries to routed articles, and what of them is stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.constants import ALERTS, EXCLUDED, LOCATION, TRUSTED
from newsweave.functions import dates, text, urls

from .dedup import first_seen, not_stored


@dataclass(frozen=True)
class ScanOptions:
    """`max_keywords`, `max_domains`: only the newest keywords and first domains take part; `suffix_match`: trust a
    domain and its subdomains only, not every host that contains it; `days`: entries older than this are dropped."""

    days: int = 5
    max_keywords: int = 100
    max_domains: int = 100
    suffix_match: bool = False
    excluded: Sequence[str] = field(default_factory=lambda: list(EXCLUDED))
    alerts: Sequence[str] = field(default_factory=lambda: list(ALERTS))


def trusted(source: Column, domains: Sequence[str], suffix_match: bool = False) -> Column:
    """Whether any domain, in small letters, is contained in the source (or, as an option, is its end)."""
    domains = [d.lower() for d in domains]
    if suffix_match:
        return F.exists(text.literals(domains), lambda d: (source == d) | F.endswith(source, F.concat(F.lit("."), d)))
    return text.contains_one_of(source, domains)


#: what a scan makes of an entry's texts, whichever other entries there are
DERIVED = ("keywords_matched", "case_count")


def derived(entries: DataFrame, keywords: Sequence[str], options: ScanOptions | None = None) -> DataFrame:
    """Entries with keywords_matched, case_count and the summary cut to its length (null without a match), so that no exchange carries whole texts.

    `route` does this first; entries that have it already, for the same keywords and options, can be joined before they are routed.
    """
    o = options or ScanOptions()
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("description"), F.lit("")) if "description" in entries.columns else F.coalesce("summary", F.lit(""))
    found = text.match_keywords(F.coalesce("title", F.lit("")), list(keywords or [])[: o.max_keywords], o.excluded)
    made = entries.withColumns({"title": F.coalesce("title", F.lit("")), "keywords_matched": found})
    of_hits = lambda c: F.when(F.col("keywords_matched").isNotNull(), c)
    return made.withColumns({"case_count": of_hits(text.case_count(F.concat_ws(" ", "title", body))), "summary": of_hits(text.truncated(body)), **({"description": of_hits(F.col("description"))} if "description" in entries.columns else {})})


def route(entries: DataFrame, keywords: Sequence[str], domains: Sequence[str], existing: DataFrame | None, as_of: Column, options: ScanOptions | None = None) -> DataFrame:
    """First-seen, fresh, matching entries with their derived columns and `route`: saved, existing or unknown.

    `keywords` newest first; `domains` in stored order, the default list where empty; `existing`: stored links.
    A null or empty keyword list gives no rows. The cheap title tests come before the date and the derived columns.
    """
    o = options or ScanOptions()
    keywords, domains = list(keywords or [])[: o.max_keywords], list(domains or [])[: o.max_domains] or TRUSTED
    if not set(DERIVED) <= set(entries.columns):
        entries = derived(entries, keywords, o)
    seen = first_seen(entries)
    hits = seen.filter(F.col("keywords_matched").isNotNull())
    fresh = hits.withColumn("published_date", dates.or_now(F.col("published"), as_of)).filter(F.col("published_date") >= as_of - F.expr(f"INTERVAL {o.days} DAYS"))
    full = fresh.withColumn("source", urls.domain(F.col("link")))
    full = full.withColumns({
        "tags": text.tags(F.col("title"), F.col("published_date"), as_of, o.alerts),
        "primary_disease": text.primary_disease(F.col("keywords_matched")), "is_whitelisted": trusted(F.col("source"), domains, o.suffix_match),
    })
    if existing is None:
        return full.withColumn("route", F.when(F.col("is_whitelisted"), F.lit("saved")).otherwise(F.lit("unknown")))
    links = existing.select(F.col("link").alias("_link")).distinct().withColumn("_stored", F.lit(True))
    known = full.join(links, F.col("link") == F.col("_link"), "left").drop("_link")
    where = F.when(~F.col("is_whitelisted"), F.lit("unknown")).when(F.col("_stored"), F.lit("existing")).otherwise(F.lit("saved"))
    return known.withColumn("route", where).drop("_stored")


ARTICLE = ("title", "link", "summary", "source", "published_date", "keywords_matched", "tags", "is_whitelisted")


def saved(routed: DataFrame) -> DataFrame:
    return routed.filter("route = 'saved'")


def unknown(routed: DataFrame, fetch_unknown: bool = True) -> DataFrame:
    """The articles of unverified sources, only if they were asked for; stored ones are not left out."""
    return routed.filter((F.col("route") == "unknown") & F.lit(fetch_unknown)).select(*ARTICLE)


def cases(routed: DataFrame, as_of: Column) -> DataFrame:
    """One case row for each saved article with a case count: its first keyword, the fixed location, its date."""
    rows = saved(routed).filter("case_count > 0")
    return rows.select("link", F.col("primary_disease").alias("disease_name"), "case_count", F.lit(LOCATION).alias("location"), F.coalesce("published_date", as_of).alias("report_date"))


def counts(routed: DataFrame) -> DataFrame:
    return saved(routed).agg(F.count("*").alias("saved_trusted_count"))


def approve(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """Articles chosen by hand and not stored yet; they bring no case row."""
    return not_stored(articles, existing)
