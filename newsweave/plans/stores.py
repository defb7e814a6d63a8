"""Queries over stores filled from the driver's tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions import html, urls
from newsweave.operators import scan
from newsweave.sources import places, store

from . import registry, searches, views

TREND_DAYS = 3


def _keywords(s: SparkSession, d: str) -> DataFrame:
    """All nations; the newest and the third go; then the regions, which take later ids."""
    own, now = store.Store(s, places.new(s, "store")), datetime.fromisoformat(registry.NOW)
    nations = views.table(s, d, "nation").select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("text"))
    own.add_keyword_rows(nations, now)
    own.add_keyword_rows(nations.filter("_n % 2 = 0"), now, strict=False)
    for id_ in (nations.count(), 3):
        own.delete_keyword(id_)
    own.add_keyword_rows(views.table(s, d, "region").select(F.col("r_regionkey").alias("_n"), F.col("r_name").alias("text")), now, strict=False)
    return own.read("keywords")


def _domains(s: SparkSession, d: str) -> DataFrame:
    """The hosts of the pages, in capitals, by their first page."""
    own = store.Store(s, places.new(s, "store"))
    hosts = views.table(s, d, "pages").groupBy(F.upper(urls.domain(F.col("url"))).alias("domain")).agg(F.min("page_id").alias("_n"))
    own.add_domain_rows(hosts)
    return own.read("whitelist_domains")


def _by_hand(s: SparkSession, d: str) -> DataFrame:
    """A scan's articles, then those of other sources that were approved by hand."""
    own = registry._stored(s, d)
    own.save_articles(scan.unknown(scan.route(registry._scanned(s, d), views.KEYWORDS, views.TRUSTED, None, F.col("as_of"), registry.OPTIONS)), F.current_timestamp().cast("timestamp_ntz"), strict=False)
    return own.read("article_identity")


def _trends(s: SparkSession, d: str) -> DataFrame:
    """The last days before the newest stored article, from its time of day on."""
    own = registry._stored(s, d)
    newest = own.read("article_identity").agg(F.max("published_date")).first()[0]
    return own.trends(TREND_DAYS, newest or datetime.fromisoformat(registry.NOW))


def _meta(s: SparkSession, d: str) -> DataFrame:
    """Three pages in four have a description in one of the three meta tags."""
    says = F.concat(F.lit("Trang "), F.col("page_id"), F.lit(" &amp; tin. Hai! Ba. Bốn."))
    tag = lambda key, name: F.concat(F.lit(f'<meta {key}="{name}" content="'), says, F.lit('">'))
    pages = views.table(s, d, "pages")
    head = searches._by(F.col("page_id"), [tag("name", "description"), tag("property", "og:description"), tag("name", "twitter:description"), F.lit("")])
    return pages.select("page_id", html.snippet(F.concat(head, F.col("html"))).alias("snippet"))


QUERIES = {
    "stored_keywords": _keywords,
    "stored_domains": _domains,
    "stored_by_hand": _by_hand,
    "stored_overview": lambda s, d: registry._stored(s, d).overview(F.lit(registry.NOW).cast("timestamp_ntz")),
    "stored_trends": _trends,
    "stored_link": lambda s, d: registry._stored(s, d).find("article_identity", "id", 2).drop("published_date"),
    "html_meta_snippet": _meta,
}

_KEPT = registry._STORED
ORACLES = {
    "stored_keywords": f"""SELECT id, text, TIMESTAMP '{registry.NOW}' AS created_at FROM (
  SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS text FROM nation) WHERE id <> 3 AND id <> (SELECT count(*) FROM nation)
  UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey), r_name, TIMESTAMP '{registry.NOW}' FROM region""",
    "stored_domains": f"SELECT row_number() OVER (ORDER BY first) AS id, domain, true AS is_active FROM (SELECT {registry._DOMAIN.format('url')} AS domain, min(page_id) AS first FROM pages GROUP BY 1)",
    "stored_by_hand": f"""{_KEPT}, hand AS (SELECT title, link, published_date FROM routed WHERE route = 'unknown')
  SELECT id, title, link, published_date FROM kept UNION ALL
  SELECT (SELECT count(*) FROM kept) + row_number() OVER (ORDER BY link), title, link, published_date FROM hand""",
    "stored_overview": f"""{_KEPT} SELECT count(*) AS total_articles, CAST(coalesce(sum(case_count), 0) AS BIGINT) AS total_cases,
  count(*) FILTER (WHERE tags LIKE '%{registry.TAG_ALERT}%') AS alert_count, TIMESTAMP '{registry.NOW}' AS last_updated FROM kept""",
    "stored_trends": f"""{_KEPT} SELECT strftime(published_date, '%Y-%m-%d') AS date, CAST(sum(case_count) AS BIGINT) AS cases FROM kept
  WHERE case_count > 0 AND published_date >= (SELECT max(published_date) FROM kept) - INTERVAL {TREND_DAYS} DAY GROUP BY 1""",
    "stored_link": f"{_KEPT} SELECT id, title, link FROM kept WHERE id = 2",
    "html_meta_snippet": f"SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'Trang ' || page_id || ' & tin. Hai! Ba.' ELSE {searches._SNIPPET} END AS snippet FROM pages",
}
