"""The bootstrap of contextual patterns and flat files of 32 bits."""

import math
from collections import defaultdict

import numpy as np

from newsweave.llm import pii, token_counts


def test_found_instances_induce_patterns(spark):
    texts = [f"please write to user{i}@host{i}.example now" for i in range(20)] + [f"please write to jane{i}(at)host now" for i in range(4)]
    texts += [f"or ask under jane{i}(at)host soon" for i in range(4)] + ["or ask under omar7(at)home soon", "or look near house12 soon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[28] == "email:13:26"
    assert got[29] == ""
    assert [got[k] for k in (20, 24)] == ["email:16:29", "email:13:26"]


def test_bootstrap_against_plain_loops(spark):
    own = np.random.default_rng(3)
    lefts, kinds = [f"left {k}" for k in range(12)], {}
    base, loose = [], []
    for _ in range(400):
        left, n = lefts[int(own.integers(12))], int(own.integers(90))
        kind = kinds.setdefault(n, int(own.integers(4)))
        (base if own.random() < 0.55 and int(left[5:]) < 8 else loose).append((left, kind, f"v{n}"))
    span = "array<struct<start:int,kind:int,end:int,value:string,left:string>>"
    rows = [([(0, k, 1, v, le) for le, k, v in base[i::7]], [(0, (pii.WORD, pii.RUN, pii.INNER)[hash(v) % 3], 1, v, le) for le, _, v in loose[i::7]]) for i in range(7)]
    frame = spark.createDataFrame(rows, f"base {span}, loose {span}")
    edges = {(le, v, g) for le, _, v in base for g in (True, False)}
    for _, spans in rows:
        for _, form, _, v, le in spans:
            edges |= {(le, v, g) for g in {pii.RUN: [True], pii.INNER: [False]}.get(form, [True, False])}
    fixed = {(v, k): 1.0 for _, k, v in base}
    scores, of = dict(fixed), defaultdict(int)
    for le, _, g in edges:
        of[le, g] += 1
    for _ in range(pii.ROUNDS):
        total, sure = defaultdict(float), defaultdict(int)
        for le, v, g in edges:
            for k in range(4):
                if (v, k) in scores and (k in pii.GROUPED_KINDS) == g:
                    total[le, k, g] += scores[v, k]
                    sure[le, k, g] += scores[v, k] >= pii.SURE
        conf = {key: total[key] / of[key[0], key[2]] for key in total if sure[key] >= pii.SEEDS}
        miss = defaultdict(float)
        for le, v, g in edges:
            for (l2, k, g2), c in conf.items():
                if (l2, g2) == (le, g):
                    miss[v, k] += math.log1p(-min(c, 0.999))
        scores = {key: 1 - math.exp(x) for key, x in miss.items()} | fixed
    want = {}
    for (le, k, _), c in conf.items():
        if c >= pii.SURE:
            want[le] = max(want.get(le, (0, 0)), (c, -k))
    assert {r.left: r.kind for r in pii._bootstrap(frame).collect()} == {le: -k for le, (_, k) in want.items()}


def test_a_long_word_is_no_pattern(spark):
    rows = [(i, f"{'x' * 60} to user{i}@host{i}.example") for i in range(5)] + [(9, f"{'y' * 60}{'x' * 44} to jane9(at)host")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == ""


def test_flat_ids_of_32_bits(spark, tmp_path):
    ids = np.array([70000, 5, 50256, 50256, 1 << 20, 50256], "<u4")
    ids.tofile(tmp_path / "ids-0.bin")
    got = token_counts.scan_flat(spark, str(tmp_path), dtype="<u4").orderBy("nth").collect()
    assert [(r.n_tokens, r.ended) for r in got] == [(2, True), (0, True), (1, True)]
    assert token_counts.id_type() == "<u2"


def test_words_of_any_length_make_patterns(spark):
    """The two words before an identifier, however far they reach, in texts of any length."""
    for word in ("x" * 60, "x" * 3000):
        lead = f"{word} under"
        rows = [(i, f"some text. {lead} user{i}@host{i}.example") for i in range(5)] + [(8, f"{lead} jane9(at)host"), (9, f"y{lead} jane9(at)host"), (10, f"{'z ' * 3000}{lead}{' ' * 90}jane9(at)host")]
        got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[8] == f"email:{len(lead) + 1}:{len(lead) + 14}"
        assert got[9] == ""
        assert got[10] == f"email:{6000 + len(lead) + 90}:{6000 + len(lead) + 103}"
