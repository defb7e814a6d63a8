"""Queries of the keyword search, the feed reader and single column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.constants import KEYWORD_SETS, NO_TREND, TRUSTED
from newsweave.functions import dates, display, html, text, urls
from newsweave.operators import dedup, scan, search, selection, stats
from newsweave.sources import feeds, places

from . import registry, views

HOSTS = [TRUSTED[0], "a.test", TRUSTED[3].upper(), "b.test"]
#: feeds written and read again, and how many consecutive entries of a feed share a file
READ_FEEDS, FILE_ENTRIES = 3, 150
MANY_FEEDS = 60

#: one written form of a date for each remainder of event_id by eight: pattern and what follows it
DATE_FORMS = [("EEE, dd MMM yyyy HH:mm:ss", " +0700"), ("EEE, dd MMM yyyy HH:mm:ss", " EST"), ("yyyy-MM-dd'T'HH:mm:ss", "Z"), ("yyyy-MM-dd HH:mm:ss", ""), ("yyyy-MM-dd'T'HH:mm:ss", "+02:00"), ("MMM d, yyyy", ""), ("'no' 'date'", ""), ("dd MMM yyyy HH:mm", " ICT")]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "documents")


def _by(number: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (number % len(values) + 1).cast("int"))


def _written_dates(s: SparkSession, d: str) -> DataFrame:
    made = [F.concat(F.date_format("ts", pattern), F.lit(rest)) for pattern, rest in DATE_FORMS]
    return views.table(s, d, "events").select("event_id", dates.parsed(_by(F.col("event_id"), made)).alias("published"))


#: twenty more, for remainders by twenty: pattern, what follows, and the date in SQL from t (whole seconds)
MORE_FORMS = [
    ("yyyyMMdd'T'HHmmss", "Z", "t"), ("yyyyMMdd", "", "date_trunc('day', t)"), ("EEEE, d MMMM yyyy HH:mm:ss", " UTC", "t"), ("MMMM d, yyyy h:mm:ss a", "", "t"), ("EEE MMM d HH:mm:ss yyyy", "", "t"),
    ("EEE MMM d HH:mm:ss 'UTC' yyyy", "", "t"), ("MM/dd/yyyy HH:mm:ss", "", "t"), ("yyyy/M/d H:mm:ss", "", "t"), ("d-MMM-yyyy HH:mm:ss", "", "t"), ("HH:mm:ss d MMM yyyy", "", "t"),
    ("d MMM yyyy HH:mm:ss", " +07", "t - INTERVAL 7 HOUR"), ("d MMM yyyy HH:mm:ss", " GMT+3", "t + INTERVAL 3 HOUR"), ("d MMM yyyy HH:mm:ss", " +0700 (ICT)", "t - INTERVAL 7 HOUR"), ("MMM d, yyyy 'at' h:mm:ss a", " EST", "t + INTERVAL 5 HOUR"),
    ("yyyy-MM-dd'T'HH:mm:ss", ".75-05:30", "t + INTERVAL 330 MINUTE"), ("d MMM yy HH:mm:ss", "", "t"), ("MMM d", "", "NULL"), ("d MMM yyyy HH:mm:ss 'pm'", "", "CASE WHEN hour(t) > 12 THEN NULL WHEN hour(t) = 12 THEN t ELSE t + INTERVAL 12 HOUR END"), ("yyyy-MM-dd '25:00'", "", "NULL"), ("yyyy MMM d HH:mm:ss", "", "t"),
]


def _more_dates(s: SparkSession, d: str) -> DataFrame:
    made = [F.concat(F.date_format("ts", pattern), F.lit(rest)) for pattern, rest, _ in MORE_FORMS]
    return views.table(s, d, "events").select("event_id", dates.parsed(_by(F.col("event_id"), made)).alias("published"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Every entry as a found article, its date written in one of four zones."""
    e = views.entries(s, d)
    text_ = F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), _by(F.col("entry_ord"), [F.lit(z) for z in (" +0700", " EST", " GMT", "")]))
    return search.labelled_report(e.select(F.col("entry_ord").alias("n"), "title", F.date_format(dates.as_written(text_), "yyyy-MM-dd HH:mm").alias("published"), "link", F.lit("...").alias("summary")))


def _coded(url: Column) -> Column:
    """A link as a news.google.com article link."""
    size = F.unhex(F.lpad(F.hex(F.length(url)), 2, "0"))
    packed = F.concat(F.unhex(F.lit("081322")), size, F.encode(url, "UTF-8"), F.unhex(F.lit("D20100")))
    return F.concat(F.lit("https://news.google.com/rss/articles/"), F.translate(F.base64(packed), "+/\r\n", "-_"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    forms = [F.concat(F.lit("https://r.test/?a=1&url="), url, F.lit("&b=2")), _coded(url), F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit(";v=1?x=2#y"))]
    return views.table(s, d, "pages").select("page_id", urls.resolved(_by(F.col("page_id"), forms)).alias("link"))


def _read_feeds(s: SparkSession, d: str, many: int = READ_FEEDS) -> DataFrame:
    """Three (or as `many`) feeds written as RSS files of a bounded number of items, a seventh of them without title and link, and read again."""
    plain = lambda c: F.replace(F.replace(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    e = views.entries(s, d)
    head = F.concat(tag("link", plain(F.col("link"))), tag("title", plain(F.col("title"))))
    item = F.concat(F.when(F.col("entry_ord") % 7 != 6, head).otherwise(F.lit("")), tag("pubDate", F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0700"))))
    items = e.select((F.col("entry_ord") % many).alias("feed"), F.lpad(F.floor(F.col("entry_ord") / many / FILE_ENTRIES).cast("string"), 12, "0").alias("file"), F.struct("entry_ord", tag("item", item).alias("xml")).alias("one"))
    files = items.groupBy("feed", "file").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["xml"]), "\n"), F.lit("</channel></rss>")).alias("value"))
    path = places.new(s, "feeds")
    files.write.partitionBy("feed", "file").text(path)
    return feeds.read_feeds(s, [f"{path}/feed={k}" for k in range(many)])


def _hosted(s: SparkSession, d: str, keywords: list[str]) -> DataFrame:
    e = views.entries(s, d).drop("html")
    host = _by(F.col("entry_ord"), [F.lit(h) for h in HOSTS])
    made = e.withColumn("link", F.concat(F.lit("https://www."), host, F.lit("/"), F.col("entry_ord")))
    return scan.route(made, keywords, [], None, F.col("as_of"), registry.OPTIONS).select("entry_ord", "source", "is_whitelisted", "route")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return search.candidates(registry._raw_entries(s, d), views.KEYWORDS, 30, F.lit(registry.NOW).cast("timestamp_ntz"))


QUERIES = {
    "trend_empty": lambda s, d: stats.labelled(stats.trends(views.cases(s, d), 0, F.col("as_of") + F.expr("INTERVAL 1 DAY"))),
    "route_without_keywords": lambda s, d: _hosted(s, d, []),
    "route_default_domains": lambda s, d: _hosted(s, d, views.KEYWORDS),
    "selection_picked": lambda s, d: selection.without(selection.picked(views.identity(s, d), views.table(s, d, "pages").filter("page_id % 2 = 0").select(F.col("url").alias("link"))), 1).select("id", "link"),
    "keyword_sets_expanded": lambda s, d: views.table(s, d, "nation").select("n_nationkey", F.explode(text.expanded(_by(F.col("n_nationkey"), [F.lit(" SEBS "), F.lit("sgain\t"), F.concat(F.lit("\n "), F.col("n_name"), F.lit(" \t"))]))).alias("keyword")),
    "text_stripped": lambda s, d: _docs(s, d).select("doc_id", text.strip(F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\r\n "))).alias("stripped")),
    "first_sentences": lambda s, d: _docs(s, d).select("doc_id", text.summarised(F.col("text")).alias("summary")),
    "token_counts": lambda s, d: _docs(s, d).select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens")),
    "resolved_links": _resolved,
    "dates_parsed": _written_dates,
    "dates_free_form": _more_dates,
    "date_or_now": lambda s, d: views.cases(s, d).select("article_id", dates.or_now(F.when(F.col("article_id") % 3 != 0, F.col("report_date")), F.col("as_of")).alias("published")),
    "json_rows": lambda s, d: views.table(s, d, "events").select("event_id", display.as_json(F.struct("event_id", "ts")).alias("json")),
    "search_candidates": lambda s, d: _candidates(s, d).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm")),
    "search_report": lambda s, d: search.report(views.identity(s, d).select(F.col("id").alias("n"), "title", F.date_format("published_date", "yyyy-MM-dd HH:mm").alias("published"), "link", F.lit("...").alias("summary"))),
    "search_report_labelled": _labelled,
    "feeds_read": lambda s, d: _read_feeds(s, d).select("feed_ord", "entry_ord", "link", "title", "published", "malformed"),
    "feeds_read_many": lambda s, d: _read_feeds(s, d, MANY_FEEDS).select("feed_ord", "entry_ord", "link", "published", "malformed"),
    "feeds_read_health": lambda s, d: stats.feed_health(_read_feeds(s, d), "malformed"),
}

_E = registry._ENTRIES
_TRIMMED = r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), ';[^/]*$', '')"
_HOST = f"[{', '.join(repr(h) for h in HOSTS)}][1 + entry_ord % {len(HOSTS)}]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SETS = {name: registry._list([k.strip() for k in members.split(",")]) for name, members in KEYWORD_SETS.items()}
_HOSTED = f"""WITH {_E}, h AS (SELECT *, lower({_HOST}) AS source FROM ent WHERE NOT ({registry._EXCLUDED.format('title')}) AND nullif({registry._MATCHED.format('title')}, '') IS NOT NULL AND published >= as_of - INTERVAL 5 DAY)
SELECT entry_ord, source, source LIKE '%{TRUSTED[0]}%' OR source LIKE '%{TRUSTED[3]}%' AS is_whitelisted, CASE WHEN source LIKE '%.test' THEN 'unknown' ELSE 'saved' END AS route FROM h"""
# RSS items by feed, in the order of their entries
_FEEDS = rf"""WITH {_E}, read AS (SELECT CAST(entry_ord % {READ_FEEDS} AS INT) AS feed_ord, row_number() OVER (PARTITION BY entry_ord % {READ_FEEDS} ORDER BY entry_ord) - 1 AS entry_ord, entry_ord % 7 = 6 AS malformed,
  CASE WHEN entry_ord % 7 <> 6 THEN link END AS link, CASE WHEN entry_ord % 7 <> 6 THEN trim(regexp_replace(title, '\s+', ' ', 'g')) END AS title, date_trunc('second', published) - INTERVAL 7 HOUR AS published FROM ent)"""
# the greedy choice of titles: pairs within the edit bound, their longest common subsequence row by row, then one title after another
_COMMON = """recursive_lcs AS (SELECT a, b, x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS r FROM near
  UNION ALL SELECT a, b, x, y, i + 1, list_transform(range(length(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k > 0 AND y[k] = x[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))) FROM recursive_lcs WHERE i < length(x)),
pairs AS MATERIALIZED (SELECT a, b FROM recursive_lcs WHERE i = length(x) AND 200 * r[length(y) + 1] >= 95 * (length(x) + length(y)))"""
_NEAR = "near AS MATERIALIZED (SELECT p.{0} AS a, q.{0} AS b, p.norm AS x, q.norm AS y FROM once p JOIN once q ON p.{0} < q.{0} AND abs(length(p.norm) - length(q.norm)) <= (length(p.norm) + length(q.norm)) // 20 WHERE levenshtein(p.norm, q.norm) <= (length(p.norm) + length(q.norm)) // 20)"
_GREEDY = f"""placed AS MATERIALIZED (SELECT *, lower({_STRIP.format('title')}) AS norm, row_number() OVER (ORDER BY feed_ord, entry_ord) AS place FROM wanted),
once AS MATERIALIZED (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY norm ORDER BY place) = 1),
{_NEAR.format('place')}, {_COMMON},
turns AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS turn FROM pairs GROUP BY b),
walk AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS gone UNION ALL
  SELECT t.turn, CASE WHEN len(list_filter(t.before, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, t.b) ELSE w.gone END FROM walk w JOIN turns t ON t.turn = w.turn + 1),
gone AS (SELECT unnest(gone) AS place FROM walk WHERE turn = (SELECT max(turn) FROM walk)),
kept AS (SELECT * FROM once WHERE place NOT IN (SELECT place FROM gone))"""
_WANTED = f"""wanted AS (SELECT feed_ord, entry_ord, {_STRIP.format('title')} AS title, {_TRIMMED.format('link')} AS link, date_trunc('second', published) AS published FROM ent
  WHERE {_STRIP.format('title')} <> '' AND date_trunc('second', published) >= TIMESTAMP '{registry.NOW}' - INTERVAL 30 DAY AND len(list_filter({registry._list(views.KEYWORDS)}, lambda k: contains(lower(title), k))) > 0)"""
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200C}}\x{{200D}}]+|[^\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200C}}\x{{200D}}\s]'))"
_SENTENCES = r"array_to_string(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' ')"
# pages of the fixture have no description: the first paragraph of more than ten tokens
_PLAIN = r"""replace(replace(replace(replace(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
_PARAGRAPHS = f"list_filter(list_transform(string_split(html, '<p>')[2:], lambda x: {_STRIP.format(_PLAIN)}), lambda t: {_TOKENS.format('t')} > 10)"
_SNIPPET = _SENTENCES.format(f"coalesce({_PARAGRAPHS}[1], '')")

ORACLES = {
    "trend_empty": f"SELECT '{NO_TREND}' AS name, CAST(0 AS BIGINT) AS cases",
    "route_without_keywords": f"{_HOSTED} WHERE false",
    "route_default_domains": _HOSTED,
    "selection_picked": f"WITH {_E} SELECT entry_ord AS id, link FROM ent WHERE link IN (SELECT url FROM pages WHERE page_id % 2 = 0) AND entry_ord <> 1",
    "keyword_sets_expanded": f"SELECT n_nationkey, unnest(CASE n_nationkey % 3 WHEN 0 THEN {_SETS['sebs']} WHEN 1 THEN {_SETS['sgain']} ELSE [n_name] END) AS keyword FROM nation",
    "text_stripped": f"SELECT doc_id, {_STRIP.format('text')} AS stripped FROM documents",
    "first_sentences": f"SELECT doc_id, {_SENTENCES.format(_STRIP.format('text'))} AS summary FROM documents",
    "token_counts": f"SELECT doc_id, {_TOKENS.format('text')} AS n_tokens FROM documents",
    "resolved_links": f"SELECT page_id, {_TRIMMED.format('url')} AS link FROM pages",
    "dates_parsed": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN t - INTERVAL 7 HOUR WHEN 1 THEN t + INTERVAL 5 HOUR WHEN 4 THEN t - INTERVAL 2 HOUR WHEN 5 THEN date_trunc('day', t)
  WHEN 6 THEN NULL WHEN 7 THEN date_trunc('minute', t) - INTERVAL 7 HOUR ELSE t END AS published FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)""",
    "dates_free_form": f"SELECT event_id, CASE event_id % {len(MORE_FORMS)} {' '.join(f'WHEN {i} THEN {sql}' for i, (*_, sql) in enumerate(MORE_FORMS))} END AS published FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)",
    "date_or_now": f"WITH {registry._CASE_ROWS} SELECT article_id, CASE WHEN article_id % 3 <> 0 THEN report_date ELSE as_of END AS published FROM cases",
    "json_rows": """SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC"}' AS json FROM events""",
    "search_candidates": f"WITH {_E}, {_WANTED} SELECT feed_ord, entry_ord, title, link, strftime(published, '%Y-%m-%d %H:%M') AS published FROM wanted",
    "search_report": f"WITH {_E} SELECT entry_ord AS n, entry_ord || '. ' || title || chr(10) || strftime(published, '%Y-%m-%d %H:%M') || chr(10) || link || chr(10) || '...' AS entry FROM ent",
    "search_report_labelled": f"""WITH {_E} SELECT entry_ord AS n, concat_ws(chr(10), '[' || entry_ord || '] ' || title, 'Ngày: ' || strftime(published, '%Y-%m-%d %H:%M'),
  'Link: ' || link, 'Tóm tắt: ...', repeat('-', 80)) AS entry FROM ent""",
    "feeds_read": f"{_FEEDS} SELECT feed_ord, entry_ord, link, title, published, malformed FROM read",
    "feeds_read_many": f"{_FEEDS.replace(f'entry_ord % {READ_FEEDS}', f'entry_ord % {MANY_FEEDS}')} SELECT feed_ord, entry_ord, link, published, malformed FROM read",
    "feeds_read_health": f"{_FEEDS} SELECT feed_ord, count(*) AS entries, count(*) FILTER (WHERE malformed) AS malformed FROM read GROUP BY 1",
    "title_near_dup_pairs": f"WITH RECURSIVE {_E}, once AS (SELECT entry_ord, lower(title) AS norm FROM ent WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY feed_ord, entry_ord) = 1), {_NEAR.format('entry_ord')}, {_COMMON} SELECT a, b FROM pairs",
    "title_fuzzy_dedup": f"WITH RECURSIVE {_E}, wanted AS (SELECT feed_ord, entry_ord, title FROM ent), {_GREEDY} SELECT entry_ord, title FROM kept",
    "html_snippet": f"SELECT page_id, {_SNIPPET} AS snippet FROM pages",
    "search_news": f"""WITH RECURSIVE {_E}, {_WANTED}, {_GREEDY},
  own AS (SELECT {_TRIMMED.format('url')} AS link, {_SNIPPET} AS summary FROM pages QUALIFY row_number() OVER (PARTITION BY {_TRIMMED.format('url')} ORDER BY page_id) = 1)
  SELECT row_number() OVER (ORDER BY feed_ord, entry_ord) AS n, title, strftime(published, '%Y-%m-%d %H:%M') AS published, link, summary FROM kept JOIN own USING (link) WHERE {_TOKENS.format('summary')} >= 10""",
}
