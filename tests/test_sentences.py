"""Learnt sentence ends against the formulas in plain Python, and what they do to texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsweave.operators import sentences

rng = random.Random(5)
NOUNS = ["bệnh", "sởi", "người", "thành phố", "hospital", "region", "outbreak", "vaccine", "tuần", "doctor", "ngày", "report"]


def text():
    out = []
    for _ in range(rng.randrange(3, 9)):
        words = [rng.choice(NOUNS) for _ in range(rng.randrange(3, 9))]
        if rng.random() < 0.5:
            words.insert(rng.randrange(1, len(words)), rng.choice(["Dr. An", "TP. HCM", "U.S. side", "e.g. this", "3.5 cases", "J. Smith", "vv. đó"]))
        out.append(" ".join([rng.choice(["The", "Các", "In"]), *words]) + rng.choice([".", ".", ".", "!", "?"]))
    return " ".join(out)


TEXTS = [text() for _ in range(400)] + [None, "", "  ", "..."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def model(docs):
    return sentences.learn(docs)


def kind(token):
    return re.sub(r"^[^\w]+|[^\w.!?…]+$", "", token.lower())


def test_abbreviation_scores(docs):
    stop, plain = Counter(), Counter()
    for t in TEXTS:
        for token in (t or "").split():
            k = kind(token)
            bare = re.sub(r"[.!?…]+$", "", k)
            if bare:
                (stop if re.search(r"[^.!?…]\.$", k) else plain)[bare] += 1
    total, stops = sum(stop.values()) + sum(plain.values()), sum(stop.values())
    want = {}
    for bare, ab in stop.items():
        if re.search(r"[^\W\d_]", bare):
            a, p = ab + plain[bare], stops / total
            ratio = -2 * (ab * math.log(p) + plain[bare] * math.log(1 - p) - ab * math.log(0.99) - plain[bare] * math.log(0.01))
            inner = bare.count(".")
            letters = len(bare) - inner
            score = ratio * math.exp(-letters) * (inner + 1) * letters ** -plain[bare]
            if score >= 0.3:
                want[bare] = (ab, a - ab, round(score, 6))
    got = {r.bare: (r.with_stop, r.without_stop, round(r.score, 6)) for r in sentences.abbreviations(sentences.tokens(docs)).collect()}
    assert got == want


def test_model(model):
    assert {"dr", "tp", "u.s", "e.g", "vv"} <= set(model.abbreviations)
    assert not {"sởi", "region", "smith"} & set(model.abbreviations)
    assert "the" in model.starters
    assert "j smith" in model.collocations


CASES = [
    ("Ông ở TP. HCM gặp Dr. An lúc 3.5 giờ. Rồi về.", ["Ông ở TP. HCM gặp Dr. An lúc 3.5 giờ.", "Rồi về."]),
    ("He saw J. Smith in the U.S. side! Was it?  Yes.", ["He saw J. Smith in the U.S. side!", "Was it?", "Yes."]),
    ('It said "no." Then e.g. this went on... and on. End', ['It said "no."', "Then e.g. this went on... and on.", "End"]),
    ("In TP. The report came.", ["In TP.", "The report came."]),
    ("   ", []), ("", []), (None, None), ("no mark", ["no mark"]), ("a\x01b. C", ["a b. C"]), ("Ends with Dr.", ["Ends with Dr."]),
]


def test_sentences(spark, model):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.s for r in frame.select("i", sentences.sentences(F.col("t"), model).alias("s")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    first = frame.filter("i = 0").select(sentences.summarised(F.col("t"), model, 1).alias("s")).first().s
    assert first == CASES[0][1][0]


def test_nothing_learnt(spark, docs):
    none = sentences.learn(docs.limit(0))
    assert none == sentences.Model()
    got = docs.limit(1).select(sentences.sentences(F.lit("Meet Dr. An. Go."), none).alias("s")).first().s
    assert got == ["Meet Dr.", "An.", "Go."]


def test_a_token_is_typed_once(spark):
    """Repeats of a token are one row with their number, before any pattern is matched."""
    docs = spark.createDataFrame([("a Dr. a Dr. b ",)] * 50, "text string")
    got = {(r.bare, r.stopped, r.n) for r in sentences.tokens(docs).collect()}
    assert got == {("a", False, 100), ("dr", True, 100), ("b", False, 50)}
    assert sentences.tokens(docs).count() == 3
    assert sentences.learn_abbreviations(docs).abbreviations == sentences.learn(docs).abbreviations


def test_no_abbreviation_is_dropped(spark):
    """A model knows all that was learnt, however long its lists are, and long lists say the same as short ones."""
    code = "concat(char(97 + k % 26), char(97 + k div 26 % 26), char(97 + k div 676))"
    docs = spark.range(6500 * 4).selectExpr("cast(id % 6500 as int) as k").selectExpr("k", f"{code} as code").selectExpr("k", "code", "concat(code, '. Word', repeat(' word', 24)) as text")
    model = sentences.learn_abbreviations(docs)
    want = {r.code for r in docs.select("code").distinct().collect()}
    assert len(model.abbreviations) == 6500
    assert set(model.abbreviations) == want
    assert docs.filter(F.size(sentences.sentences(F.col("text"), model)) != 1).count() == 0
    others = ["zzzz", "word", "a", "", "aa\ta", "é", None, *sorted(want)[:50]]
    frame = spark.createDataFrame([(t,) for t in others], "t string")
    got = [r.known for r in frame.select(sentences._among(F.col("t"), model.abbreviations).alias("known")).collect()]
    assert got == [None if t is None else t in want for t in others]
