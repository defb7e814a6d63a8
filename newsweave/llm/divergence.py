"""How sources of a language differ in their terms: chi-square-like divergences between sources, and each source's own terms.

Terms are runs of letters (A-Z made small) and non-ASCII characters. Chunks of documents give (source, term) counts, which are summed; a term's counts over
the sources of its language form a sparse vector, and terms with one vector are one column. Each pair of sources is evaluated once for each
distinct vector and multiplied by how many terms have it; a source's own terms are scored on the vector too and only the
best ranks go back to the terms.

Arithmetic is whole numbers throughout: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q). Vectors are dealt in buckets of about
`BUCKET` of a language, whose source totals come along; sources of a language are taken `BLOCK` at a time, so a task holds `BLOCK` rows of a pair
table at most. Nothing is broadcast.

Null text, lang and source are empty strings; repeated rows count each; a null doc_id changes nothing; a language without kept terms has
pairs of value 0 and no terms; a language of one source has no pairs; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import buffers, chunks, release, text_column
from .shared import removed, shared_path, until_exit

SCALE = 1_000_000_000
LEAST_DOCS, MOST_TERMS = 3, 200
BUCKET, BLOCK, SLICE = 20_000, 256, 1 << 16
VALUE = "lang string, source string, item string, vid string, value bigint"
CHUNK_BYTES = 4 << 20
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
SAFE = 9_000_000_000  # counts whose product with SCALE fits 64 bits


def _counting(batches):
    """Counts of each chunk's (lang, source, term)."""
    for batch in chunks(batches, limit=CHUNK_BYTES):
        data, offs = buffers(text_column(batch))
        data = _SMALL[data]
        inside = _LETTER[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offs[:-1][offs[:-1] < len(data)]
        begins[edge] = inside[edge]  # a term ends with its text
        flat = data[inside]
        start = np.append(np.flatnonzero(begins[inside]), len(flat)).astype(np.int32)
        doc = np.searchsorted(offs, np.flatnonzero(begins), "right") - 1
        if not len(doc):
            continue
        terms = pa.StringArray.from_buffers(len(doc), pa.py_buffer(start), pa.py_buffer(flat)).dictionary_encode()
        names = [text_column(batch, c).fill_null("").dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
        kinds, sources = len(terms.dictionary), len(names[1].dictionary)
        pair, n = np.unique(doc * kinds + terms.indices.to_numpy(), return_counts=True)  # (document, term)
        group = (lang * sources + source)[pair // kinds] * kinds + pair % kinds
        key, at, docs = np.unique(group, return_inverse=True, return_counts=True)
        total = np.bincount(at, n, len(key)).astype(np.int64)
        take = lambda values, x: values.take(pa.array(x))
        columns = [take(names[0].dictionary, key // kinds // sources), take(names[1].dictionary, key // kinds % sources), take(terms.dictionary, key % kinds), pa.array(total), pa.array(docs)]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    counted = docs.select("lang", "source", "text").mapInArrow(_counting, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms: lang, term, vector (array of source, n in source order), vid (a digest of the vector)."""
    pairs = F.array_sort(F.collect_list(F.struct("source", "n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), pairs.alias("vector")).filter(F.col("docs") >= least_docs)
    return kept.select("lang", "term", "vector", F.sha2(F.to_json("vector"), 256).alias("vid"))


def chances(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (n + 1) / total), exactly."""
    if n.size and n.max() >= SAFE:
        return np.array([1 + SCALE * (a + 1) // b for a, b in zip(n.tolist(), total.tolist())], np.int64)
    return 1 + SCALE * (n + 1) // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _bucket(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Pair sums and term scores of one bucket of vectors and one block of sources. `right`: all sources of the language."""
    lang, _, block = (k.as_py() for k in key)
    right = right.sort_by("source")
    names, total, kinds = right["source"].to_pylist(), right["total"].to_numpy(), int(right["terms"][0].as_py())
    count = len(names)
    lo, hi = block * BLOCK, min(count, (block + 1) * BLOCK)
    sums = np.zeros((hi - lo, count), np.int64)
    base = chances(np.zeros(count, np.int64), total + kinds) if kinds else np.ones(count, np.int64)
    score: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    vector = left["vector"].combine_chunks() if left.num_rows else None
    for at in range(0, left.num_rows, step := max(1, SLICE // max(count, 1))):
        part = vector.slice(at, step)
        rows = len(part)
        flat = part.flatten()
        sizes = np.diff(part.offsets.to_numpy())
        row = np.repeat(np.arange(rows), sizes)
        col = np.searchsorted(names, flat.field("source").to_pylist()) if rows else row
        n = flat.field("n").to_numpy()
        times = left["times"].slice(at, step).to_numpy()
        p = np.tile(base, (rows, 1))
        p[row, col] = chances(n, total[col] + kinds)
        there = np.zeros((rows, count), bool)
        there[row, col] = True
        # pairs whose first source has the term
        for s in range(lo, hi):
            own = np.flatnonzero(there[:, s])
            sums[s - lo] += times[own] @ divergence(p[own, s][:, None], p[own])
        # pairs whose first source lacks it: second ones that have it, then those that lack it too
        lacking = ~there[:, lo:hi]
        for t in range(count):
            own = np.flatnonzero(there[:, t])
            sums[:, t] += times[own] @ (divergence(base[lo:hi][None, :], p[own, t][:, None]) * lacking[own])
        neither = (lacking.T * times) @ (~there).astype(np.int64)
        sums += neither * divergence(base[lo:hi][:, None], base[None, :])
        if block == 0:
            all_n = np.bincount(row, n, rows).astype(np.int64) if n.sum() < 1 << 53 else np.array([int(x.sum()) for x in np.split(n, np.cumsum(sizes)[:-1])], np.int64)
            q = chances(all_n, np.full(rows, total.sum() + kinds))[row]
            own_p = p[row, col]
            high = np.flatnonzero(own_p > q)
            score.append((row[high] + at, col[high], divergence(own_p[high], q[high])))
    s, t = np.nonzero(np.arange(lo, hi)[:, None] != np.arange(count)[None, :])
    label = pa.array(names, pa.string())
    row, col, value = (np.concatenate([x[i] for x in score] or [np.zeros(0, np.int64)]) for i in range(3))
    none = pa.nulls(len(s), pa.string())
    columns = [
        pa.array([lang] * (len(s) + len(row)), pa.string()), pa.concat_arrays([label.take(pa.array(s + lo)), label.take(pa.array(col))]), pa.concat_arrays([label.take(pa.array(t)), pa.nulls(len(row), pa.string())]),
        pa.concat_arrays([none, left["vid"].combine_chunks().take(pa.array(row))]) if len(row) else none, pa.array(np.concatenate([sums[s, t], value])),
    ]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "vid", "value"])


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    spark = docs.sparkSession
    root = shared_path(spark, "divergence")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    terms = written(vectors(term_counts(docs), least_docs), "terms")
    until_exit(spark, root)
    distinct = written(terms.groupBy("lang", "vid", "vector").agg(F.count("*").alias("times")), "vectors")
    held = distinct.select("lang", "times", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("x.n") * F.col("times")).alias("total"))
    per_lang = distinct.groupBy("lang").agg(F.sum("times").alias("terms"), F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(held, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("buckets", F.lit(1)).alias("buckets"))
    groups = written(groups, "groups")
    blocks = groups.groupBy("lang").agg(F.max("buckets").alias("buckets"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stats = groups.drop("buckets").join(blocks, "lang").withColumn("bucket", each("buckets")).withColumn("block", each("blocks"))
    dealt = distinct.join(blocks, "lang").withColumn("bucket", F.expr("cast(pmod(xxhash64(vid), buckets) as int)")).withColumn("block", each("blocks"))
    keys = ("lang", "bucket", "block")
    found = dealt.select(*keys, "vid", "vector", "times").groupBy(*keys).cogroup(stats.select(*keys, "source", "total", "terms").groupBy(*keys)).applyInArrow(_bucket, VALUE)
    values = written(found, "values")
    removed(spark, f"{root}/groups")
    pairs = values.filter("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    # no source ranks more than `most_terms` terms of one vector
    first = terms.select("lang", "vid", "term").withColumn("nth", F.row_number().over(W.partitionBy("lang", "vid").orderBy("term"))).filter(F.col("nth") <= most_terms)
    own = values.filter("item is null").select("lang", "vid", "source", "value").join(first.drop("nth"), ["lang", "vid"])
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= most_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(own.withColumn("part", F.lit("term")).withColumnRenamed("term", "item").select(*columns))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
x AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.n + l.v) AS BIGINT) AS p,
        CAST(1 + 1000000000::HUGEINT * (kept.n + 1) // (l.n + l.v) AS BIGINT) AS q
      FROM t JOIN kept ON kept.lang = t.lang JOIN l ON l.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
o AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM u
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
