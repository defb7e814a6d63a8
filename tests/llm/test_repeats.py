"""Many rows of one key, and tables whose columns clash with names used inside."""

import pytest
from pyspark.sql import functions as F

from newsweave.llm import decontaminate, mixing, near_dup, quality, toxicity


@pytest.fixture(scope="module")
def many(spark):
    """300 documents and 2,001 rows of one key."""
    other = spark.range(300).select("id", F.concat(F.lit("some plain words of text number "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    same = spark.range(2001).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("vile words again and again in row "), (F.col("id") % 5).cast("string")).alias("text"), F.lit("x").alias("source"))
    return other.unionByName(same).withColumnRenamed("id", "doc_id").cache()


def test_fits_stay_bounded(spark, many, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    sent = []
    real = type(many).toArrow
    monkeypatch.setattr(type(many), "toArrow", lambda self: sent.append(real(self)) or sent[-1])
    toxicity.fit(many, labels, None)
    quality.fit(many, labels)
    assert [t.num_rows for t in sent] == [300, 100]


def test_mix_meets_targets_with_repeated_rows(spark):
    docs = spark.range(997).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three four five six seven").alias("text"), F.lit("x").alias("source"))
    docs = docs.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("eight nine ten").alias("text"), F.lit("y").alias("source")))
    target = {r.source: (r.target, r.size) for r in mixing.copies(docs).collect()}
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    for source, (goal, size) in target.items():
        assert abs(taken[source] - goal) <= size


@pytest.mark.parametrize("names", [("n_id", "l_id", "c_id", "c_own"), ("row", "size", "copy", "times"), ("kept_id", "leaking", "drawn_row", "Row")])
def test_clashing_names(spark, names):
    texts = ["a b c d e f g", "a b c d e f g", "the passage of the benchmark that leaks into one of these texts", None, ""]
    rows = [(i, t, "s", *[str(i)] * len(names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names if n != "Row") + (", `Row2` string" if "Row" in names else ""))
    bench = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = near_dup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [0, 1, 3, 4]
    for out in (kept, mixing.mix(docs), decontaminate.drop_leaks(docs, bench), toxicity.drop_toxic(docs, labels)):
        assert out.columns == docs.columns
        assert all(r[3] == str(r.doc_id) for r in out.collect())


def test_mixing_again(spark):
    """The same rows in other orders and partitions are drawn alike, repeated ids and rows included."""
    rows = [(i % 50, " ".join(["w"] * (1 + i % 7)) + str(i % 90), "abc"[i % 3], i % 4) for i in range(1000)] + [(None, f"null key {i % 5}", "a", i % 2) for i in range(40)]
    seen = []
    for k, order in ((4, rows), (7, rows[::-1]), (1, sorted(rows, key=str))):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, rest int").repartition(k)
        report = sorted(map(str, mixing.mix_report(docs).collect()))
        seen.append((report, sorted(map(str, mixing.mix(docs).collect()))))
    assert seen[0] == seen[1] == seen[2]


def test_more_buckets_draw_alike(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.lit("s").alias("source"))
    few = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "PER_BUCKET", 1)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == few
