"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.constants import LOCATION, TAG_ALERT, TAG_NEW
from newsweave.functions import display, html, text, urls
from newsweave.operators import dedup, numbering, scan, search, selection, stats
from newsweave.sources import places, store

from . import views

NOW = "2024-01-31 00:00:00"
OPTIONS = scan.ScanOptions(excluded=views.EXCLUDED, alerts=views.ALERTS)


def _scanned(s: SparkSession, d: str, summary: Column | None = None) -> DataFrame:
    """Entries with what a scan makes of their texts, made before they are joined."""
    own = lambda rows: rows if summary is None else rows.withColumn("summary", summary)
    return views.entries(s, d, lambda rows: scan.derived(own(rows), views.KEYWORDS, OPTIONS)).drop("html")


def _routed(s: SparkSession, d: str, summary: Column | None = None) -> DataFrame:
    e = _scanned(s, d, summary)
    existing = views.table(s, d, "pages").filter("page_id % 5 = 0").select(F.col("url").alias("link"))
    return scan.route(e, views.KEYWORDS, views.TRUSTED, existing, F.col("as_of"), OPTIONS)


SCAN_COLUMNS = ["entry_ord", "link", "title", "source", "published_date", "keywords_matched", "primary_disease", "tags", "case_count", "is_whitelisted", "route"]


def _flagship(s: SparkSession, d: str) -> DataFrame:
    return _routed(s, d).select(*SCAN_COLUMNS, "summary")


def _case_texts(s: SparkSession, d: str, rest: Column) -> DataFrame:
    docs = views.table(s, d, "documents")
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("Ghi nhận "), n, F.lit(" ca, "))).when(k == 1, F.concat(F.lit("phát hiện 3 ca và "), n, F.lit(" ca mắc "))).when(k == 2, F.concat(n, F.lit(".500 TRƯỜNG HỢP "))).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(made, rest).alias("t"))


def _raw_entries(s: SparkSession, d: str) -> DataFrame:
    return views.entries(s, d).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages by trimmed link, the first of equal ones."""
    return dedup.first_seen(views.table(s, d, "pages").select("page_id", urls.trim_url(F.col("url")).alias("url"), "html"), "url", ["page_id"])


#: two entries in three report cases, one of them none
_CASE_SUMMARY = "concat(CASE entry_ord % 3 WHEN 0 THEN concat('Ghi nhận ', entry_ord, ' ca, ') WHEN 1 THEN 'có 12  ca mắc; ' ELSE '' END, summary)"


def _stored(s: SparkSession, d: str) -> store.Store:
    """A store after two scans of the same entries; the second finds nothing new."""
    own = store.Store(s, places.new(s, "store"))
    own.create()
    for _ in range(2):
        routed = scan.route(_scanned(s, d, F.expr(_CASE_SUMMARY)), views.KEYWORDS, views.TRUSTED, own.read("article_identity"), F.col("as_of"), OPTIONS)
        own.save_scan(routed, F.col("published_date"))
    return own


QUERIES = {
    "scan_flagship": _flagship,
    "scan_trusted_new": lambda s, d: scan.saved(_routed(s, d)).select("entry_ord", "link", "source"),
    "scan_unknown": lambda s, d: scan.unknown(_routed(s, d)).select("title", "link", "source", "keywords_matched", "tags"),
    "scan_saved_count": lambda s, d: scan.counts(_routed(s, d)),
    "scan_cases": lambda s, d: scan.cases(_routed(s, d).withColumn("case_count", F.length("title")), F.col("published_date")),
    "scan_cases_found": lambda s, d: scan.cases(_routed(s, d, F.expr(_CASE_SUMMARY)), F.col("published_date")),
    "stored_articles": lambda s, d: stats.flat_articles((x := _stored(s, d)).read("article_identity"), x.read("article_details")).drop("summary"),
    "stored_cases": lambda s, d: _stored(s, d).read("disease_cases").drop("id"),
    "cases_of_article": lambda s, d: stats.articles_with_cases(views.identity(s, d), views.cases(s, d)).select("id", "title", "disease_name", "case_count"),
    "trusted_mixed_case": lambda s, d: views.table(s, d, "pages").filter(scan.trusted(urls.domain(F.col("url")), [x.title() for x in views.TRUSTED])).select("page_id"),
    "first_seen_link": lambda s, d: dedup.first_seen(views.entries(s, d)).select("link", "feed_ord", "entry_ord"),
    "keyword_match": lambda s, d: views.table(s, d, "documents").select("doc_id", F.array_join(text.matched(F.col("text"), views.KEYWORDS), ", ").alias("matched")),
    "keyword_exclusion": lambda s, d: views.table(s, d, "documents").filter(~text.is_excluded(F.col("text"), views.EXCLUDED)).select("doc_id"),
    "keyword_explode_counts": lambda s, d: views.table(s, d, "documents").select(F.explode(text.matched(F.col("text"), views.KEYWORDS)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")),
    "tag_new_alert": lambda s, d: views.entries(s, d).select("entry_ord", text.tags(F.col("title"), F.col("published"), F.col("as_of"), views.ALERTS).alias("tags")),
    "case_count_extract": lambda s, d: _case_texts(s, d, F.col("text")).select("doc_id", text.case_count(F.col("t")).alias("cases")),
    "primary_disease": lambda s, d: views.table(s, d, "documents").select("doc_id", text.primary_disease(text.match_keywords(F.col("text"), views.KEYWORDS, views.EXCLUDED)).alias("disease")),
    "summary_truncate": lambda s, d: views.table(s, d, "documents").select("doc_id", text.truncated(F.col("text")).alias("summary")),
    "source_domain": lambda s, d: views.table(s, d, "pages").select("page_id", urls.domain(F.col("url")).alias("source")),
    "trim_url": lambda s, d: views.table(s, d, "pages").select("page_id", urls.trim_url(F.col("url")).alias("trimmed")),
    "extract_original_link": lambda s, d: views.table(s, d, "pages").select("page_id", urls.original_link(F.concat(F.lit("https://r.test/?a=1&url="), F.col("url"))).alias("link")),
    "decode_source_url": lambda s, d: views.table(s, d, "pages").select("page_id", urls.source_url(F.concat(F.lit("https://news.google.com/rss/articles/"), F.translate(F.base64(F.concat(F.unhex(F.lit("081322")), F.unhex(F.lpad(F.hex(F.length("url")), 2, "0")), F.encode("url", "UTF-8"), F.unhex(F.lit("D20100")))), "+/\r\n", "-_"))).alias("link")),
    "trusted_domain_semi": lambda s, d: views.table(s, d, "pages").filter(scan.trusted(urls.domain(F.col("url")), views.TRUSTED)).select("page_id"),
    "existing_link_anti": lambda s, d: dedup.not_stored(views.entries(s, d), views.table(s, d, "pages").filter("page_id % 5 = 0").select(F.col("url").alias("link"))).select("entry_ord", "link"),
    "articles_page": lambda s, d: stats.page(views.identity(s, d), F.desc("published_date"), F.desc("id"), skip=20, limit=10).select("id", "link", "published_date"),
    "keywords_page": lambda s, d: stats.page(views.table(s, d, "nation").select("n_nationkey", "n_name"), F.desc("n_nationkey"), skip=5, limit=10),
    "whitelist_page": lambda s, d: stats.ui_page(views.table(s, d, "nation").select("n_nationkey", "n_name"), F.asc("n_nationkey"), number=2),
    "overview": lambda s, d: stats.overview(views.identity(s, d), views.details(s, d), views.cases(s, d), F.lit(NOW).cast("timestamp_ntz")),
    "trends_daily": lambda s, d: stats.trends(views.cases(s, d), 7, F.col("as_of")),
    "trends_labeled": lambda s, d: stats.labelled(stats.trends(views.cases(s, d), 7, F.col("as_of"))),
    "article_dto": lambda s, d: stats.flat_articles(views.identity(s, d), views.details(s, d)),
    "disease_share": lambda s, d: stats.shares(views.cases(s, d)),
    "tool_accuracy": lambda s, d: stats.accuracy(views.table(s, d, "labels").join(views.table(s, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", F.col("quality") == 1),
    "tool_lift": lambda s, d: stats.lift(views.table(s, d, "part").select("p_partkey", (F.col("p_size") + 1).alias("base"), F.col("p_retailprice").alias("other")), "base", "other"),
    "monthly_pivot": lambda s, d: stats.monthly(views.table(s, d, "orders"), "o_orderdate", F.when(F.col("o_orderstatus") == "F", "vietnam").otherwise("global"), F.lit(1), ["vietnam", "global"]),
    "feed_health": lambda s, d: stats.feed_health(views.entries(s, d)),
    "top3_per_feed": lambda s, d: stats.first_of_feed(views.entries(s, d)).select("feed_ord", "entry_ord", "nth"),
    "trend_vs_prev_day": lambda s, d: stats.change(stats.trends(views.cases(s, d), 30, F.col("as_of"))),
    "trend_spikes": lambda s, d: stats.spikes(stats.trends(views.cases(s, d), 30, F.col("as_of"))).select("date", "cases", "is_spike"),
    "row_numbers": lambda s, d: numbering.numbered(views.table(s, d, "orders").select("o_orderkey", "o_orderdate"), "n", F.desc("o_orderdate"), F.asc("o_orderkey"), after=100),
    "display_columns": lambda s, d: views.table(s, d, "orders").select("o_orderkey", display.badge(F.col("o_orderstatus") == "F").alias("badge"), display.grouped(F.col("o_orderkey")).alias("grouped"), display.local_date(F.col("o_orderdate")).alias("day")),
    "list_parts": lambda s, d: views.table(s, d, "part").select("p_partkey", F.array_join(display.listed(F.replace("p_name", F.lit(" "), F.lit(" , "))), "|").alias("parts")),
    "selection_toggle": lambda s, d: views.table(s, d, "nation").select("n_nationkey", F.array_join(selection.toggled(F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("n_nationkey")), ",").alias("chosen")),
    "selection_tally": lambda s, d: selection.tally(views.table(s, d, "customer").withColumnRenamed("c_nationkey", "k"), views.table(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), "k"),
    "title_near_dup_pairs": lambda s, d: dedup.near_pairs(dedup.first_seen(views.entries(s, d).withColumn("title", F.lower("title")), "title").select(F.col("entry_ord").alias("id"), "title")),
    "title_fuzzy_dedup": lambda s, d: dedup.fuzzy_first(views.entries(s, d).select("feed_ord", "entry_ord", "title")).select("entry_ord", "title"),
    "search_news": lambda s, d: search.search_news(_raw_entries(s, d), _pages(s, d), views.KEYWORDS, 30, F.lit(NOW).cast("timestamp_ntz")),
    "html_snippet": lambda s, d: views.table(s, d, "pages").select("page_id", html.snippet("html").alias("snippet")),
}

_ENTRIES = """e0 AS (SELECT CAST(d.doc_id % 11 AS INT) AS feed_ord, d.doc_id AS entry_ord, p.url AS link, substr(d.text, 1, 80) AS title, d.text AS summary, e.ts AS published
  FROM documents d JOIN events e ON e.event_id = d.doc_id * 5 JOIN pages p ON p.page_id = CAST(floor(d.doc_id / 4) AS BIGINT)),
ent AS (SELECT *, max(published) OVER () AS as_of FROM e0)"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_MATCHED = f"array_to_string(list_filter({_list(views.KEYWORDS)}, lambda k: contains(lower({{0}}), k)), ', ')"
_EXCLUDED = f"len(list_filter({_list(views.EXCLUDED)}, lambda x: contains(lower({{0}}), x))) > 0"
_ALERT = f"len(list_filter({_list(views.ALERTS)}, lambda a: contains(lower({{0}}), a))) > 0"
_TRUSTED = f"len(list_filter({_list(views.TRUSTED)}, lambda w: contains({{0}}, w))) > 0"
_DOMAIN = r"replace(lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), 'www.', '')"
_TAGS = f"nullif(concat_ws(', ', CASE WHEN {{1}} > {{2}} - INTERVAL 5 HOUR THEN '{TAG_NEW}' END, CASE WHEN {_ALERT} THEN '{TAG_ALERT}' END), '')"
_TRUNCATED = "CASE WHEN length({0}) > 500 THEN substr({0}, 1, 500) || '...' ELSE {0} END"
_P1 = r"'(\d+)\s+(ca\s+mắc|trường\s+hợp|người\s+nhiễm|ca\s+dương\s+tính)'"
_P2 = r"'(phát\s+hiện|ghi\s+nhận)\s+(\d+)\s+(ca|trường\s+hợp)'"
_CASES = f"coalesce(try_cast(nullif(regexp_extract(lower({{0}}), {_P1}, 1), '') AS INT), try_cast(nullif(regexp_extract(lower({{0}}), {_P2}, 2), '') AS INT), 0)"
_ROUTED = f"""WITH {_ENTRIES},
seen AS (SELECT * FROM ent WHERE link <> '' QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed_ord, entry_ord) = 1),
hit AS (SELECT *, nullif({_MATCHED.format("title")}, '') AS keywords_matched FROM seen WHERE NOT ({_EXCLUDED.format("title")})),
r AS (SELECT entry_ord, link, title, {_DOMAIN.format("link")} AS source, published AS published_date, keywords_matched, split_part(keywords_matched, ', ', 1) AS primary_disease,
  {_TAGS.format("title", "published", "as_of")} AS tags, {_CASES.format("title || ' ' || summary")} AS case_count, {_TRUSTED.format(_DOMAIN.format("link"))} AS is_whitelisted, {_TRUNCATED.format("summary")} AS summary
  FROM hit WHERE keywords_matched IS NOT NULL AND published >= as_of - INTERVAL 5 DAY),
routed AS (SELECT r.*, CASE WHEN NOT is_whitelisted THEN 'unknown' WHEN link IN (SELECT url FROM pages WHERE page_id % 5 = 0) THEN 'existing' ELSE 'saved' END AS route FROM r)"""
_ROUTED_CASES = _ROUTED.replace("d.text AS summary", "CASE d.doc_id % 3 WHEN 0 THEN 'Ghi nhận ' || d.doc_id || ' ca, ' WHEN 1 THEN 'có 12  ca mắc; ' ELSE '' END || d.text AS summary")
_STORED = _ROUTED_CASES.replace(" WHEN link IN (SELECT url FROM pages WHERE page_id % 5 = 0) THEN 'existing'", "").replace("SELECT entry_ord, link, title,", "SELECT feed_ord, entry_ord, link, title,") + ", kept AS (SELECT *, row_number() OVER (ORDER BY feed_ord, entry_ord) AS id FROM routed WHERE route = 'saved')"
_CASE_ROWS = "c0 AS (SELECT event_id AS article_id, event_type AS disease_name, CAST(floor(value) AS BIGINT) AS case_count, ts AS report_date FROM events), cases AS (SELECT *, max(report_date) OVER () AS as_of FROM c0)"
_TREND = "trend AS (SELECT strftime(report_date, '%Y-%m-%d') AS date, CAST(sum(case_count) AS BIGINT) AS cases FROM cases WHERE report_date >= as_of - INTERVAL {0} DAY GROUP BY 1)"
_DETAILS = f"""details AS (SELECT entry_ord AS article_id, {_TRUNCATED.format("summary")} AS summary, {_DOMAIN.format("link")} AS source,
  CASE WHEN NOT ({_EXCLUDED.format("title")}) THEN nullif({_MATCHED.format("title")}, '') END AS keywords_matched, {_TAGS.format("title", "published", "as_of")} AS tags, entry_ord % 2 = 0 AS is_whitelisted FROM ent WHERE entry_ord % 3 <> 0)"""

ORACLES = {
    "scan_flagship": f"{_ROUTED} SELECT {', '.join(SCAN_COLUMNS)}, summary FROM routed",
    "scan_trusted_new": f"{_ROUTED} SELECT entry_ord, link, source FROM routed WHERE route = 'saved'",
    "scan_unknown": f"{_ROUTED} SELECT title, link, source, keywords_matched, tags FROM routed WHERE route = 'unknown'",
    "scan_saved_count": f"{_ROUTED} SELECT count(*) AS saved_trusted_count FROM routed WHERE route = 'saved'",
    "scan_cases": f"{_ROUTED} SELECT link, primary_disease AS disease_name, CAST(length(title) AS INT) AS case_count, '{LOCATION}' AS location, published_date AS report_date FROM routed WHERE route = 'saved' AND length(title) > 0",
    "scan_cases_found": f"{_ROUTED_CASES} SELECT link, primary_disease AS disease_name, case_count, '{LOCATION}' AS location, published_date AS report_date FROM routed WHERE route = 'saved' AND case_count > 0",
    "stored_articles": f"{_STORED} SELECT id, title, link, published_date, source, keywords_matched, tags, is_whitelisted FROM kept",
    "stored_cases": f"{_STORED} SELECT id AS article_id, primary_disease AS disease_name, case_count, '{LOCATION}' AS location, published_date AS report_date FROM kept WHERE case_count > 0",
    "cases_of_article": f"WITH {_ENTRIES} SELECT entry_ord AS id, title, event_type AS disease_name, CAST(floor(value) AS BIGINT) AS case_count FROM ent JOIN events ON event_id = entry_ord",
    "trusted_mixed_case": f"SELECT page_id FROM pages WHERE {_TRUSTED.format(_DOMAIN.format('url'))}",
    "first_seen_link": f"WITH {_ENTRIES} SELECT link, feed_ord, entry_ord FROM ent QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed_ord, entry_ord) = 1",
    "keyword_match": f"SELECT doc_id, {_MATCHED.format('text')} AS matched FROM documents",
    "keyword_exclusion": f"SELECT doc_id FROM documents WHERE NOT ({_EXCLUDED.format('text')})",
    "keyword_explode_counts": f"SELECT keyword, count(*) AS n FROM (SELECT unnest(list_filter({_list(views.KEYWORDS)}, lambda k: contains(lower(text), k))) AS keyword FROM documents) GROUP BY 1",
    "tag_new_alert": f"WITH {_ENTRIES} SELECT entry_ord, {_TAGS.format('title', 'published', 'as_of')} AS tags FROM ent",
    "case_count_extract": f"""SELECT doc_id, {_CASES.format("t")} AS cases FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ghi nhận ' || n_chars || ' ca, ' WHEN 1 THEN 'phát hiện 3 ca và ' || n_chars || ' ca mắc '
  WHEN 2 THEN n_chars || '.500 TRƯỜNG HỢP ' ELSE '' END || text AS t FROM documents)""",
    "primary_disease": f"SELECT doc_id, CASE WHEN NOT ({_EXCLUDED.format('text')}) THEN nullif(split_part({_MATCHED.format('text')}, ', ', 1), '') END AS disease FROM documents",
    "summary_truncate": f"SELECT doc_id, {_TRUNCATED.format('text')} AS summary FROM documents",
    "source_domain": f"SELECT page_id, {_DOMAIN.format('url')} AS source FROM pages",
    "trim_url": r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS trimmed FROM pages",
    "extract_original_link": r"SELECT page_id, regexp_extract('https://r.test/?a=1&url=' || url, 'url=(https?://[^&]+)', 1) AS link FROM pages",
    "decode_source_url": "SELECT page_id, url AS link FROM pages",
    "trusted_domain_semi": f"SELECT page_id FROM pages WHERE {_TRUSTED.format(_DOMAIN.format('url'))}",
    "existing_link_anti": f"WITH {_ENTRIES} SELECT entry_ord, link FROM ent WHERE link NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)",
    "articles_page": f"WITH {_ENTRIES} SELECT entry_ord AS id, link, published AS published_date FROM ent ORDER BY published DESC, entry_ord DESC LIMIT 10 OFFSET 20",
    "keywords_page": "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC LIMIT 10 OFFSET 5",
    "whitelist_page": "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 10",
    "overview": f"""WITH {_ENTRIES}, {_DETAILS} SELECT (SELECT count(*) FROM ent) AS total_articles, (SELECT CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) FROM events) AS total_cases,
  (SELECT count(*) FROM ent JOIN details ON article_id = entry_ord WHERE tags LIKE '%{TAG_ALERT}%') AS alert_count, TIMESTAMP '{NOW}' AS last_updated""",
    "trends_daily": f"WITH {_CASE_ROWS}, {_TREND.format(7)} SELECT * FROM trend",
    "trends_labeled": f"WITH {_CASE_ROWS}, {_TREND.format(7)} SELECT substr(date, 6, 2) || '/' || substr(date, 9, 2) AS name, cases FROM trend",
    "article_dto": f"WITH {_ENTRIES}, {_DETAILS} SELECT entry_ord AS id, title, link, published AS published_date, details.summary, source, keywords_matched, tags, coalesce(is_whitelisted, false) AS is_whitelisted FROM ent LEFT JOIN details ON article_id = entry_ord",
    "disease_share": f"WITH {_CASE_ROWS} SELECT disease_name, CAST(sum(case_count) AS BIGINT) AS total, CAST(round(sum(case_count) / (SELECT sum(case_count)::DOUBLE FROM cases) * 100, 0) AS BIGINT) AS percent FROM cases GROUP BY 1",
    "tool_accuracy": "SELECT lang, count(*) AS articles, count(*) FILTER (WHERE quality = 1) AS relevant, round(count(*) FILTER (WHERE quality = 1) * 100.0::DOUBLE / count(*), 1) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "tool_lift": "SELECT p_partkey, p_size + 1 AS base, p_retailprice AS other, round((p_retailprice / (p_size + 1) - 1) * 100, 1) AS lift FROM part",
    "monthly_pivot": "SELECT 'T' || month(o_orderdate) AS month, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS vietnam, CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS global FROM orders GROUP BY 1",
    "feed_health": f"WITH {_ENTRIES} SELECT feed_ord, count(*) AS entries, CAST(0 AS BIGINT) AS malformed FROM ent GROUP BY 1",
    "top3_per_feed": f"WITH {_ENTRIES} SELECT feed_ord, entry_ord, CAST(row_number() OVER (PARTITION BY feed_ord ORDER BY entry_ord) AS INT) AS nth FROM ent QUALIFY nth <= 3",
    "trend_vs_prev_day": f"WITH {_CASE_ROWS}, {_TREND.format(30)} SELECT date, cases, cases - lag(cases) OVER (ORDER BY date) AS change FROM trend",
    "row_numbers": "SELECT o_orderkey, o_orderdate, 100 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders",
    "display_columns": f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{display.TRUSTED}' ELSE '{display.MANUAL}' END AS badge, format('{{:,}}', o_orderkey) AS grouped, day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) AS day FROM orders",
    "list_parts": "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part",
    "selection_toggle": "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2, 3) THEN array_to_string(list_filter([1, 2, 3], lambda x: x <> n_nationkey), ',') ELSE '1,2,3,' || n_nationkey END AS chosen FROM nation",
    "selection_tally": "SELECT count(*) AS found, count(*) FILTER (WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS chosen FROM customer",
    "trend_spikes": f"WITH {_CASE_ROWS}, {_TREND.format(30)} SELECT date, cases, coalesce(cases >= 2 * avg(cases) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS is_spike FROM trend",
}

#: earlier names of the same queries
for _name in ("keyword_match", "keyword_exclusion", "keyword_explode_counts", "primary_disease", "case_count_extract"):
    QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"] = QUERIES[_name], ORACLES[_name]
