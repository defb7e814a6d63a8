"""The positive-unlabelled fit against plain formulas, and what it learns."""

import tracemalloc

import numpy as np
import pytest

from newsweave.llm import toxicity


def risk(w, pos, unl, prior):
    """pi R+(positive) and R-(unlabelled) - pi R-(positive) of a logistic model, one example at a time."""
    loss = lambda z, y: np.log1p(np.exp(-y * z))
    z = lambda x: float(np.dot(x, w[:-1]) + w[-1])
    first = prior * np.mean([loss(z(x), 1) for x in pos])
    return first, np.mean([loss(z(x), -1) for x in unl]) - prior * np.mean([loss(z(x), -1) for x in pos])


@pytest.mark.parametrize("negative", [False, True])
def test_gradient(negative):
    own = np.random.default_rng(3)
    pos, unl = own.random((40, 6)).astype(np.float32), own.random((70, 6)).astype(np.float32)
    w = own.normal(0, 1, 7)
    prior = 0.9 if negative else 0.1
    if negative:
        w[-1] = 4.0 if risk(np.append(w[:-1], 4.0), pos, unl, prior)[1] < 0 else w[-1]
        unl = np.zeros_like(unl)
        w[:-1] = np.abs(w[:-1])
    first, second = risk(w, pos, unl, prior)
    assert (second < 0) == negative
    ones = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    got = toxicity.risk_gradient(w, ones(pos), ones(unl), prior)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        up, down = risk(w + step, pos, unl, prior), risk(w - step, pos, unl, prior)
        # below zero the step goes against the negative part alone
        want = -(up[1] - down[1]) / 2e-5 if negative else (sum(up) - sum(down)) / 2e-5
        assert abs(got[k] - want) < 1e-4


def test_unlabelled_set_holds_positives():
    """Positives among the unlabelled rows do not spoil the fit."""
    own = np.random.default_rng(8)
    truth = own.random(3000) < 0.1
    x = (own.random((3000, 8)) < np.where(truth[:, None], 0.6, 0.15)).astype(np.float32)
    known = np.flatnonzero(truth)[:120]
    w = toxicity.nnpu(np.vstack([x[known], x]), np.repeat([1, 0], [len(known), len(x)]), 0.1)
    z = x @ w[:-1] + w[-1]
    best = x.sum(1)  # all features tell as much, so no ranking beats their number
    caught = lambda score: truth[np.argsort(-score, kind="stable")[: truth.sum()]].mean()
    assert caught(z) > caught(best) - 0.05


def test_the_fit_leaves_the_driver_room(spark):
    """A full sample's sets and rows are held once: no copy for every place of every set, no float copies of all rows."""
    word = "concat('w', pmod(xxhash64(id, i, 7), 40000))"
    toxic = "concat_ws(' ', transform(sequence(1, 12), i -> concat('bad', pmod(xxhash64(id, i), 900))))"
    docs = spark.range(9000).selectExpr("id as doc_id", f"concat_ws(' ', if(id % 3 = 0, {toxic}, ''), array_join(transform(sequence(1, 160), i -> {word}), ' ')) as text")
    labels = spark.range(9000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    toxicity.fit(docs.limit(20), labels, None)  # what is imported and kept once does not count
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model["places"]) > 100
    assert peak < 45e6
