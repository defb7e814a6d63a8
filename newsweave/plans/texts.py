"""Queries on learnt sentence ends, long keyword lists and pages by key, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions import text
from newsweave.operators import sentences, stats

from . import registry, searches, views

#: what is put before every text, so that the corpus has abbreviations
LEAD = "Dr. An and prof. Lê saw TP. HCM for 3.5 days. They left. "


def _led(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "documents").select("doc_id", F.concat(F.lit(LEAD), F.col("text")).alias("text"))


def _abbreviations(s: SparkSession, d: str) -> DataFrame:
    found = sentences.abbreviations(sentences.tokens(_led(s, d)))
    return found.select(F.col("bare").alias("abbreviation"), "with_stop", "without_stop")


def _sentences(s: SparkSession, d: str) -> DataFrame:
    docs = _led(s, d)
    model = sentences.learn_abbreviations(docs)
    made = docs.select("doc_id", sentences.sentences(F.col("text"), model).alias("s"))
    return made.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.slice("s", 1, 3), " ").alias("summary"))


def _many_keywords(s: SparkSession, d: str) -> DataFrame:
    """Every word of the benchmark of four letters or more as a keyword, on all documents."""
    words = views.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).distinct()
    keywords = [r.w for r in words.orderBy("w").collect()]  # a keyword list
    found = text.matched(F.col("text"), keywords)
    return views.table(s, d, "documents").select("doc_id", F.array_join(found, ", ").alias("matched"))


def _after(s: SparkSession, d: str) -> DataFrame:
    """The third page of ten by the key of the second one's last row."""
    rows, last = views.identity(s, d), None
    for _ in range(2):
        last = [(r.published_date, r.id) for r in stats.page_after(rows, last, limit=10).collect()][-1]
    return stats.page_after(rows, last, limit=10).select("id", "link", "published_date")


QUERIES = {"abbreviations_learnt": _abbreviations, "sentences_learnt": _sentences, "keyword_match_many": _many_keywords, "articles_after": _after}

_KIND = r"regexp_replace(lower({0}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.!?…]+$', '', 'g')"
_BARE = r"regexp_replace({0}, '[.!?…]+$', '')"
_LEARNT = rf"""led AS (SELECT doc_id, {searches._STRIP.format(f"'{LEAD}' || text")} AS text FROM documents),
kinds AS (SELECT {_KIND.format('t')} AS kind FROM (SELECT unnest(string_split_regex(text, '\s+')) AS t FROM led) WHERE t <> ''),
counts AS (SELECT {_BARE.format('kind')} AS bare, count(*) FILTER (WHERE regexp_matches(kind, '[^.!?…]\.$')) AS w, count(*) AS n FROM kinds WHERE {_BARE.format('kind')} <> '' GROUP BY 1),
totals AS (SELECT sum(w)::DOUBLE / sum(n) AS p FROM counts),
scored AS (SELECT bare, w, n - w AS o, length(bare) - length(replace(bare, '.', '')) AS inner_,
  2 * (w * ln(0.99) + (n - w) * ln(0.01) - w * ln(p) - (n - w) * ln(1 - p)) AS ratio FROM counts, totals WHERE w > 0 AND regexp_matches(bare, '\p{{L}}')),
learnt AS (SELECT bare, w, o FROM scored WHERE ratio * exp(inner_ - length(bare)) * (inner_ + 1) * pow(length(bare) - inner_, -o) >= 0.3)"""
_LAST = _KIND.format(r"regexp_extract(p[i], '(\S+)\s*$', 1)")
_WITHIN = rf"""(regexp_matches({_BARE.format(_LAST)}, '^[0-9][0-9.,]*$') AND regexp_matches(p[i + 1], '^[^\p{{L}}\p{{N}}\s]*\p{{Ll}}')) OR list_contains(ab, {_BARE.format(_LAST)}) OR regexp_matches({_BARE.format(_LAST)}, '^\p{{L}}$')"""

ORACLES = {
    "keyword_match_many": """WITH k AS (SELECT list(w ORDER BY w) AS words FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark))
  SELECT doc_id, array_to_string(list_filter(words, lambda w: contains(lower(text), w)), ', ') AS matched FROM documents, k""",
    "articles_after": registry.ORACLES["articles_page"],
    "abbreviations_learnt": f"WITH {_LEARNT} SELECT bare AS abbreviation, w AS with_stop, o AS without_stop FROM learnt",
    "sentences_learnt": rf"""WITH {_LEARNT}, listed AS (SELECT coalesce(list(bare), []) AS ab FROM learnt),
pieces AS (SELECT doc_id, ab, string_split(regexp_replace(translate(text, chr(1), ' '), '([.!?…]["''”’»)\]]{{0,3}}\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM led, listed),
whole AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) THEN ''
  WHEN regexp_matches({_LAST}, '[^.!?…]\.$') THEN CASE WHEN {_WITHIN} THEN '' ELSE chr(1) END
  WHEN regexp_matches({_LAST}, '\.\.$|…$') AND regexp_matches(p[i + 1], '^[^\p{{L}}\p{{N}}\s]*\p{{Ll}}') THEN '' ELSE chr(1) END), '') AS t FROM pieces),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {searches._STRIP.format('x')}), lambda x: x <> '') AS s FROM whole)
SELECT doc_id, len(s) AS n_sentences, array_to_string(s[1:3], ' ') AS summary FROM cut""",
}
