"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts that labels mark toxic; the unlabelled set is drawn from all texts, positives among them, as the risk
supposes, and pi is the share of positives in it. Both are drawn as bounded samples in a
digest order (`MOST_POSITIVE`, `MOST_UNLABELLED` rows: the documented bound of the fit). A text is the set of
fingerprints of its words and of their six- and seven-byte beginnings, hashed to 2**20 places; places that occur
clearly more often in positives, and the most common ones, become the features of a logistic model in numpy. The
risk is pi * R+(positive) + max(0, R-(unlabelled) - pi * R-(positive)) with the class prior pi from the labels;
when the clipped part turns negative, the step goes against it, as the non-negative estimator prescribes. The bias is
then set so that the threshold cuts where, by the densities of positives and unlabelled, a text is toxic with that probability.

Scores lie in [0, 1]; null and empty texts score the model's bias. Null labels are unlabelled, repeated labels
count as toxic when any row says so, of rows with one doc_id one text is learnt from (all are scored), null doc_id rows are scored and never learnt from. Without positives every
score is 0; an empty table gives no rows. Only texts enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, buffers, chunks, mix, release, text_column

PLACES = 1 << 20
FEATURES = 768
MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
THRESHOLD = 0.7
PREFIXES = (6, 7)


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word and word beginning, repeats included."""
    words = Words(*buffers(text_column(batch)))
    # ASCII punctuation at either end of a word is not part of its feature
    start, end = words.start.copy(), words.end.copy()
    if len(words):
        for _ in range(4):
            start += (_PUNCT[words.data[start]]) & (start < end - 1)
            end -= (_PUNCT[words.data[end - 1]]) & (start < end - 1)
    row, out = [words.doc], [words.hashes(start, end) >> U64(44)]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        row.append(words.doc[long])
        out.append((words.hashes(start[long], start[long] + k) ^ U64(k << 50)) >> U64(44))
    return np.concatenate(row), np.concatenate(out).astype(np.int64)


_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _sample_rows(batches):
    for batch in chunks(batches):
        row, place = places(batch)
        pairs = np.unique((row.astype(np.int64) << 20) | place)
        cut = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << 20)
        raw = (pairs & (PLACES - 1)).astype(np.int32).tobytes()
        sets = pa.array([raw[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([text_column(batch, "positive"), text_column(batch, "unlabelled"), sets], names=["positive", "unlabelled", "places"])


def risk_gradient(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """The step of the non-negative risk on rows with a last column of ones: its gradient, or away from a negative part."""
    sp, su = 1 / (1 + np.exp(-np.clip(pos @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(unl @ w, -30, 30)))
    # logistic loss: log(1 + exp(-z)) for positives, log(1 + exp(z)) for negatives
    neg = -np.mean(np.log1p(-np.minimum(su, 1 - 1e-9))) + prior * np.mean(np.log1p(-np.minimum(sp, 1 - 1e-9)))
    g_neg = unl.T @ su / len(unl) - prior * (pos.T @ sp) / len(pos)
    return prior * (pos.T @ (sp - 1)) / len(pos) + g_neg if neg >= 0 else -g_neg


def nnpu(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.5, l2: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights (last: bias) of a logistic model under the non-negative risk. x: rows of numbers or flags, y: 1 positive, 0 unlabelled."""
    pos, unl = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rows = lambda at: np.hstack([x[at], np.ones((len(at), 1), np.float32)])
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(seed)
    for t in range(1, rounds + 1):
        p = rows(pos[rng.integers(0, len(pos), min(len(pos), 512))])
        u = rows(unl[rng.integers(0, len(unl), min(len(unl), 1024))])
        g = risk_gradient(w, p, u, prior)
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def threshold_shift(z: np.ndarray, y: np.ndarray, prior: float, threshold: float = THRESHOLD) -> float:
    """What to add to logits so that `threshold` cuts where a text of that logit is toxic with this probability.

    The probability at a logit is the prior times the positives' density over that of the unlabelled, made monotone by pooling
    neighbours; no negative needs to be known. The cut lies halfway in the gap below the last logit that reaches it;
    nothing is added where none does.
    """
    cuts, at = np.unique(-z, return_inverse=True)  # from the highest on
    share = [np.bincount(at[y == k], minlength=len(cuts)) / max(1, (y == k).sum()) for k in (1, 0)]
    blocks: list[list[float]] = []  # toxic mass, unlabelled mass, logits
    for toxic, unlabelled in zip(prior * share[0], share[1]):
        blocks.append([toxic, unlabelled, 1])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] > blocks[-2][0] * blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    reach = int(sum(n for toxic, unlabelled, n in blocks if toxic >= threshold * unlabelled))
    if not reach or len(cuts) == 1:
        return 0.0
    cut = -(cuts[reach - 1] + cuts[min(reach, len(cuts) - 1)]) / 2
    return float(np.log(threshold / (1 - threshold)) - cut)


def holders(sets: list[np.ndarray]) -> np.ndarray:
    """How many of the sets hold each place."""
    out = np.zeros(PLACES, np.int32)
    for s in sets:
        out[s] += 1
    return out


def first_of_copies(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which rows stay when positives are dropped that share a pair of least fingerprints of rare places with an earlier one.

    All words of a toxic text with many copies would look toxic otherwise.
    """
    common = holders(sets) > 0.02 * len(sets)
    keep, seen = np.ones(len(sets), bool), set()
    for i in np.flatnonzero(y == 1):
        rare = sets[i][~common[sets[i]]].astype(np.uint64)
        if len(rare) < 8:
            continue
        least = [int(mix(rare + U64((k + 1) << 32)).min()) for k in range(6)]
        pairs = {(k, least[k], least[k + 1]) for k in (0, 2, 4)}
        keep[i] = not pairs & seen
        seen |= pairs
    return keep


def _learnt(got: pa.Table, prior: float) -> dict:
    """The model of a sample: positive, unlabelled, places. Sets are read where Arrow holds them; nothing is made for every place of every set."""
    positive, unlabelled = (np.flatnonzero(got[c].to_numpy()) for c in ("positive", "unlabelled"))
    if not len(positive) or prior >= 1:
        return {"places": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": np.inf if len(positive) else -np.inf}
    each = [np.frombuffer(b.as_buffer(), np.int32) for b in got["places"]]
    y = np.repeat([1, 0], [len(positive), len(unlabelled)])
    sets = [each[i] for i in np.concatenate([positive, unlabelled])]
    order = np.lexsort(([s.sum() for s in sets], [len(s) for s in sets], -y))  # the same order whatever the partitions
    order = order[first_of_copies([sets[i] for i in order], y[order])]
    y, sets = y[order], [sets[i] for i in order]
    in_pos = holders([s for s, k in zip(sets, y) if k])
    in_unl = holders([s for s, k in zip(sets, y) if not k])
    often = np.flatnonzero(in_pos >= 3)
    rp, ru = (in_pos[often] + 0.5) / (y.sum() + 1), (in_unl[often] + 0.5) / ((1 - y).sum() + 1)
    gain = np.where(rp > 1.5 * ru, (rp - ru) / np.sqrt(rp / y.sum() + ru / (1 - y).sum()), 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    chosen = often[best[gain[best] > np.clip(np.sqrt(0.015 * y.sum()), 2.5, 4)]]  # about the root of the positives that hold it
    where = np.full(PLACES, -1, np.int32)
    where[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen)), bool)
    for i, s in enumerate(sets):
        at = where[s]
        x[i, at[at >= 0]] = True
    prior = min(max(prior, 0.001), 0.9)
    w = nnpu(x, y, prior)
    z = np.concatenate([x[i : i + 1024].astype(np.float32) @ w[:-1] for i in range(0, len(x), 1024)]) + w[-1]
    return {"places": chosen.astype(np.int64), "weights": w[:-1], "bias": float(w[-1]) + threshold_shift(z, y, prior)}


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, modulus: int = 3) -> dict:
    """The model: feature places, weights, bias. Rows whose remainder is `held_out` are not used."""
    # the sample is drawn on keys alone; only then are its texts read
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    if held_out is not None:
        ids = ids.filter(remainder("doc_id", modulus) != held_out)
        marks = marks.filter(remainder("l_id", modulus) != held_out)
    keyed = ids.join(marks, F.col("doc_id") == F.col("l_id"), "left").withColumn("label", (F.coalesce("toxic", F.lit(0)) == 1).cast("int"))
    keyed = keyed.withColumn("place", F.xxhash64(F.lit("nnpu"), "doc_id"))
    first = lambda rows, n, positive: rows.orderBy("place", "doc_id").limit(n).select(F.col("doc_id").alias("s_id"), F.lit(positive).alias("positive"), F.lit(1 - positive).alias("unlabelled"))
    sample = first(keyed.filter("label = 1"), MOST_POSITIVE, 1).unionByName(first(keyed, MOST_UNLABELLED, 0))
    sample = sample.groupBy("s_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    prior = marks.filter("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    # one text for each key drawn, so the sample is bounded whatever repeats
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))
    rows = rows.groupBy("s_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("positive", "unlabelled", "text").mapInArrow(_sample_rows, "positive int, unlabelled int, places binary").toArrow()
    model = _learnt(got, prior)
    del got
    release()  # the driver lives on
    return model


def score_texts(model: dict):
    table = np.zeros(PLACES, np.float32)
    table[model["places"]] = model["weights"]
    known = np.zeros(PLACES, bool)
    known[model["places"]] = True

    def run(batches):
        for batch in chunks(batches):
            row, place = places(batch)
            hit = known[place]
            pairs = np.unique((row[hit].astype(np.int64) << 20) | place[hit])
            z = model["bias"] + np.bincount(pairs >> 20, table[pairs & (PLACES - 1)], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 1, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    model = fit(docs, labels, held_out, modulus)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score_texts(model), "doc_id bigint, score double")
    held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _passing(model: dict, threshold: float):
    score = score_texts(model)

    def run(batches):
        for batch in chunks(batches):
            got = next(score(iter([batch.select(["text"])]))) if batch.num_rows else None
            if got is not None:
                yield batch.filter(pa.array(got.column(0).to_numpy() < threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, all columns as they were."""
    model = fit(docs, labels, None)
    return docs.mapInArrow(_passing(model, threshold), docs.schema)
