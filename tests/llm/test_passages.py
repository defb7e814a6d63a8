"""Passages of 50 words that several documents share, however few bytes they have."""

import random
import re

from newsweave.llm import suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
rng = random.Random(6)


def prose(n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(n))


SHARED = [prose(n) for n in (50, 51, 60, 90, 49, 36, 35)]
TEXTS = [prose(rng.randrange(0, 200)) for _ in range(40)] + [None, "", "w " * 300, prose(50)]
for k, passage in enumerate(SHARED):
    for sep in (" ", "\n"):
        TEXTS.append(prose(rng.randrange(0, 80)) + sep + passage + sep + prose(rng.randrange(0, 80)))
TEXTS += [SHARED[0] + " " + prose(5) + " " + SHARED[1], TEXTS[3] + " " + prose(60) + " " + TEXTS[3]]


def runs(least):
    """Words of each text in runs of at least so many that another text has too."""
    words = [WORD.findall((t or "").encode()) for t in TEXTS]
    where = {}
    for i, w in enumerate(words):
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = []
    for w in words:
        covered = set()
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                covered |= set(range(k, k + least))
        out.append(len(covered))
    return out


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4000)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = {tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()}
    got = suffix_dedup.remove_repeats(docs, passages=True).collect()
    assert {tuple(r)[:5] for r in got} == plain
    whole, sure = runs(50), runs(suffix_dedup.SURELY)
    assert sum(n > 0 for n in whole) >= 11
    for r in got:
        assert r.n_shared_words <= sure[r.doc_id]
        assert (r.n_shared_words > 0) >= (whole[r.doc_id] > 0)
        assert r.n_shared_words >= min(whole[r.doc_id], suffix_dedup.SURELY)
    assert suffix_dedup.remove_repeats(docs.limit(0), passages=True).count() == 0
