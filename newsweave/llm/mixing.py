"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected target / size copies. Documents stand in a fixed order of size class
and key digest (rows of one key: by a digest of their text, then of all columns), so equal stretches of the prefix sum hold like sizes; the running sum of expected copies plus
one offset of the source crosses integers, and each crossing emits the document once. The order is dealt over
buckets (size class, low digest bits and as many leading ones as the source's rows ask for): only bucket counts are summed per source, so a source with a third
of all rows is still numbered by many tasks. Rows are written once with their sizes and digests, so words are counted
once; what is drawn follows from the rows alone, whatever their order and partitions.

Null text has size 0, null source is a source of its own and comes last, null doc_id gets the digest of an empty
key; repeated rows count each and are drawn one by one; an empty table gives no rows; other columns are kept by `mix` and ignored here.
A source without words has target 0 and emits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .shared import fresh, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
BITS = 64
PER_BUCKET = 50_000  # rows of a bucket to aim at


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source_size, target. `sized`: source, size.

    The level at which capped sources stop is found in closed form: with sources by cap / weight, the first i are
    full when the rest, shared by weight, would still pass theirs.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = per.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumns({"weight": pick, "cap": F.col("source_size") * F.lit(cap)})
    placed = placed.withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(1))))
    by = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    level = placed.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(after)})
    level = level.withColumn("lam", (F.col("total") * F.lit(share) - F.col("full")) / F.col("open"))
    level = level.withColumn("is_full", F.col("cap") <= F.col("lam") * F.col("weight"))
    least = F.max(F.when(~F.col("is_full"), F.col("lam"))).over(W.partitionBy(F.lit(1)))
    level = level.withColumn("level", least)
    return level.select("source", "source_size", F.when(F.col("is_full") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """One offset in [0, 1) per source, a multiple of 1/1024."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\x00null")))), 1, 8), 16, 10).cast("long") % 1024) / F.lit(1024.0)


def _measured(docs: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame, str]:
    """The rows, written once with a number, their size and a digest of text and columns; the narrow table of these; the name of the number.

    `keep`: with all columns of `docs`.
    """
    row, size, tie = (fresh(docs, c) for c in ("row", "size", "tie"))
    plain = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    digest = F.concat(F.md5(F.coalesce(F.col("text"), F.lit(""))), F.hex(F.xxhash64(*plain, *[F.col(c).isNull() for c in plain])))
    rows = docs.withColumns({size: word_count("text"), row: F.monotonically_increasing_id(), tie: digest})
    rows = stored(rows if keep else rows.select("doc_id", "source", size, row, tie), "mix-rows")
    return rows, rows.select(F.col(row).alias("row"), "doc_id", "source", F.col(size).alias("size"), F.col(tie).alias("tie")), row


def _drawn(sized: DataFrame, weights, share: float, cap: float, seed: str) -> DataFrame:
    """`sized`: row, doc_id, source, size, tie; with source_size, target and copies."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumns({"digest": digest, "bits": F.length(F.bin("size"))})
    sized = sized.withColumn("class", F.expr("bits * 8L + (shiftright(size, greatest(bits - 4, 0)) & 7)")).drop("bits")
    sized = sized.withColumn("bucket", F.col("class") * BITS + F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % BITS)
    # rows of a bucket stand in digest order, so its leading bits cut it without changing the order
    many = F.broadcast(sized.agg(F.count("*").alias("all")))
    cuts = F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(F.col("all") / F.lit(BITS * PER_BUCKET)))))
    sized = sized.join(many, F.lit(True)).withColumn("leading", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.pow(F.lit(2.0), 32 - cuts)).cast("long"))
    sized = sized.withColumn("bucket", F.struct("bucket", "leading")).drop("leading", "all")
    counts = sized.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    targets = source_targets(counts, weights, share, cap).withColumnRenamed("source", "t_source")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = starts.join(targets, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    ranked = sized.withColumn("nth", F.row_number().over(W.partitionBy("source", "bucket").orderBy("digest", "doc_id", "tie", "row")))
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumns({"rank": F.col("base") + F.col("nth"), "rate": rate, "u": offset(F.col("source"), seed)})
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    return ranked.select("row", "doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(int(cap))).cast("long").alias("copies"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of `docs` (doc_id, text, source)."""
    _, sized, _ = _measured(docs, False)
    return _drawn(sized, weights, share, cap, seed).drop("row")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents: the rows of `docs`, each as often as it was emitted."""
    rows, sized, row = _measured(docs, True)
    times = _drawn(sized, weights, share, cap, seed).filter("copies > 0").select(F.col("row").alias("drawn_row"), F.array_repeat(F.lit(True), F.col("copies").cast("int")).alias("times"))
    drawn = times.select(F.col("drawn_row").alias(fresh(rows, "drawn_row")), F.col("times").alias(fresh(rows, "times")))
    hit = rows.join(drawn, F.col(row) == F.col(drawn.columns[0]))
    return hit.withColumn(fresh(hit, "copy"), F.explode(drawn.columns[1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
c AS (SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS bits FROM sized),
b AS (SELECT *, (bits * 8 + ((size >> greatest(bits - 4, 0)) & 7)) * 64
             + CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) % 64 AS bucket FROM c),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM per),
w AS (SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::BIGINT AS total FROM placed),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM w),
m AS (SELECT *, (total * 1.5::DOUBLE - full_) / open_ AS lam FROM l),
f AS (SELECT *, cap <= lam * weight AS is_full FROM m),
g AS (SELECT *, max(CASE WHEN NOT is_full THEN lam END) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full OR level IS NULL THEN cap ELSE level * weight END AS target,
             (CAST(('0x' || substr(md5('mix-1' || coalesce(source, chr(0) || 'null')), 1, 8)) AS BIGINT) % 1024) / 1024.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN (CASE WHEN is_full OR level IS NULL THEN cap ELSE level * weight END) / source_size ELSE 0.0::DOUBLE END AS rate FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, digest, doc_id, tie) AS rank FROM b)
SELECT r.doc_id, r.size, t.source_size, t.target,
       CAST(least(floor(r.rank * t.rate + t.u) - floor((r.rank - 1) * t.rate + t.u), 2) AS BIGINT) * r.size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
