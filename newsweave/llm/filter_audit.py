"""How five filters interact: what each removes in every order, from one relational pass.

Words are exploded and aggregated by (document, word), then by document for totals and distincts; the flags of the other filters
are outer-joined, and each part of the corpus is reduced to 32 conditional counts, one for each set of failed filters (and
as many for good and for toxic documents). All orders and steps follow from these counts alone.

A document is known by its doc_id and a 64-bit digest of its text, so that repeated and null ids stay apart; rows that repeat
both are counted as often as they come. Texts move once, to the task that counts their words. Copies are found on a SHA-256 of the text;
their rows are counted by (text, part, flags) first, so a group of copies never meets in one task.

Null text is empty (no words; fails A), null source is the part '' together with empty ones. A null doc_id is not larger
than any other and never fails E, nor makes others fail; without doc_id no label. Repeated labels count as 1 where any row says so.
Parts without documents have no rows, so an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MOST = 120  # orders of five filters


def words_per_document(keyed: DataFrame) -> DataFrame:
    """id_key, text_key, n_words, n_distinct of documents that have words. `keyed`: id_key, text_key, text."""
    dealt = keyed.select("id_key", "text_key", "text").repartition("id_key", "text_key")
    words = dealt.select("id_key", "text_key", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("at", "word"))
    # rows that repeat a document double its counts; each has one first word
    per_word = words.groupBy("id_key", "text_key", "word").agg(F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("rows"))
    per_doc = per_word.groupBy("id_key", "text_key").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.sum("rows").alias("rows"))
    return per_doc.select("id_key", "text_key", F.expr("n div rows").alias("n_words"), "n_distinct")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents: part, mask (bit i: fails the i-th filter), good, toxic, n."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"), F.xxhash64(F.col("doc_id").isNull(), text).alias("text_key"),
    )
    fails_c = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 5
    other = (fails_c.cast("int") * 4 + F.col("text").rlike("[#$%&*|]").cast("int") * 8).alias("other")
    others = own.select("doc_id", "part", "id_key", "text_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), other)
    both = others.join(words_per_document(own), ["id_key", "text_key"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    mask = (n < 50).cast("int") + (distinct * 100 < n * 65).cast("int") * 2 + F.col("other")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = both.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    rows = both.groupBy("doc_id", "id_key", "text_key", "digest", "part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kinds = rows.agg(F.count("*").alias("n")).groupBy("digest", "part", "mask", "good", "toxic")
    # all copies fail E but those with the smallest id
    kinds = kinds.agg(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    kinds = stored(kinds, "audit-kinds")  # read twice, made once
    first = kinds.groupBy("digest").agg(F.min("least").alias("first"))
    kinds = kinds.join(first, "digest")
    passing = F.coalesce("nameless", F.lit(0)) + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    failing = F.coalesce("n", F.lit(0)) + F.coalesce("nameless", F.lit(0)) - passing
    split = F.explode(F.array(F.struct(F.lit(0).alias("e"), passing.alias("n")), F.struct(F.lit(16).alias("e"), failing.alias("n"))))
    return kinds.select("part", "mask", "good", "toxic", split.alias("x")).select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic", "x.n")


def _counts(name: str, when: Column) -> list[Column]:
    """The 32 conditional-count columns of one kind."""
    return [F.coalesce(F.sum(F.when((F.col("mask") == m) & when, F.col("n"))), F.lit(0)).alias(f"{name}{m}") for m in range(MASKS)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    kinds = (("n", F.lit(True)), ("g", F.col("good") == 1), ("t", F.col("toxic") == 1))
    per_part = flagged(docs, labels).groupBy("part").agg(*[c for k, when in kinds for c in _counts(k, when)])
    counts = per_part.select("part", *[F.array(*[f"{k}{m}" for m in range(MASKS)]).alias(k) for k, _ in kinds])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = counts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda s: sum((F.contains(s, F.lit(f)).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"before": bits(F.expr("substring(filter_order, 1, step - 1)")), "own": bits(F.expr("substring(filter_order, step, 1)"))})

    def total(of: str, when: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (acc, m) -> acc + IF({when}, {of}[m], 0L))")

    removed = "(m & own) <> 0 AND (m & before) = 0"
    # of a document's k failed filters each comes first in a k-th of all orders
    shapley = F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (acc, m) -> acc + IF((m & own) <> 0, n[m] * ({MOST} div bit_count(m)), 0L))")
    return steps.select(
        "part", "filter_order", "step",
        total("n", "(m & (own | before)) = 0").alias("kept"), total("n", removed).alias("removed"), total("n", "(m & own) <> 0 AND (m & before) <> 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"), total("g", removed).alias("good_lost"), total("t", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
w AS (SELECT doc_id, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text, doc_id > first_id AS again FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
         'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(again, false)} AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM k v, k w, k x, k y, k z
      WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
s AS (SELECT part, filter_order, step, n, good, toxic,
        CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS own,
        (a AND instr(filter_order, 'A') < step) OR (b AND instr(filter_order, 'B') < step) OR (c AND instr(filter_order, 'C') < step)
          OR (d AND instr(filter_order, 'D') < step) OR (e AND instr(filter_order, 'E') < step) AS gone,
        a::INT + b::INT + c::INT + d::INT + e::INT AS failed, substr(filter_order, step, 1) AS f
      FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN own AND NOT gone THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN own AND NOT gone THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
