"""Quality rules as a learned decision list.

Every whole text gets a row of statistics; labelled rows (a bounded sample of `MOST_LABELLED` in key-digest order,
the documented bound of the fit) teach an ordered list of threshold conjunctions for "drop". Sequential covering
grows a conjunction by information gain on two thirds of what is left, prunes its tail on the other third, keeps
it if it is precise there, removes what it covers and goes on. The list comes out as one Spark `when` chain.

Words are maximal runs of characters other than space and 0x09-0x0D. Null and empty texts have zero statistics,
fail the base rule (fewer than ten words) and are not kept. Null labels and rows without doc_id teach nothing, a
repeated label counts as its least quality, of rows with one doc_id one text teaches; without labels, or with one class only, the list is empty and only
the base rule speaks. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, U64, Words, buffers, chunks, text_column, windows

MOST_LABELLED = 20_000
MOST_RULES, MOST_TERMS, LEAST_PRECISION = 12, 4, 0.6
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct")
#: name -> (numerator, denominator); a ratio with denominator 0 is 0
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "stops": ("n_stops", "n_words"), "distinct": ("n_distinct", "n_words"),
}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _STOP = _class("#*$%&|<>"), _class("0123456789"), _class(".!?")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of the group of equal (row, h), whether it is the group's first) for each element."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size, first = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    size[order] = np.bincount(group)[group] if len(r) else []
    first[order] = new
    return size, first


def statistics(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, offs = buffers(text_column(batch))
    n, words = batch.num_rows, Words(data, offs)
    out = {"n_words": np.diff(words.cut).astype(np.int64)}
    out["word_chars"] = _per_row(((data & 0xC0) != 0x80) & ~SPACE[data], offs)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP)):
        out[name] = _per_row(kind[data], offs)
    wh = words.hashes(fold=False)
    at, h = windows(wh, words.doc, WINDOW)
    size, _ = _repeats(words.doc[at], h)
    edge = np.zeros(len(wh) + 1, np.int64)
    np.add.at(edge, at[size > 1], 1)
    np.add.at(edge, at[size > 1] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=n)
    _, once = _repeats(words.doc, wh)
    out["n_distinct"] = np.bincount(words.doc[once], minlength=n)
    # lines end at \n or at the row's end; only those with a word count
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offs, start, "right") - 1
    stop = np.minimum(offs[row + 1], np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, start)])
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = solid[stop] > solid[start]
    start, stop, row = start[full], stop[full], row[full]
    _, first = _repeats(row, words.hashes(start, stop, fold=False) ^ (stop - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[~first], minlength=n)
    return out


def _stat_rows(batches):
    for batch in chunks(batches):
        got = statistics(batch)
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[*names, *COUNTS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stat_rows, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _matrix(rows: dict[str, np.ndarray]) -> np.ndarray:
    out = []
    for top, bottom in FEATURES.values():
        a = rows[top].astype(float)
        out.append(a if bottom is None else np.divide(a, rows[bottom], out=np.zeros(len(a)), where=rows[bottom] > 0))
    return np.stack(out, 1) if len(out[0]) else np.zeros((0, len(FEATURES)))


Rule = list[tuple[str, str, float]]


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    names = list(FEATURES)
    hit = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, names.index(name)]
        hit &= v >= t if op == ">=" else v <= t
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    names, rule, on = list(FEATURES), [], np.ones(len(y), bool)
    while len(rule) < MOST_TERMS and (y[on] == 0).any():
        p0, n0 = (y[on] == 1).sum(), (y[on] == 0).sum()
        best, pick = 1e-9, None
        for j, name in enumerate(names):
            v = x[on, j]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 65), method="nearest")):
                for op, hit in ((">=", v >= t), ("<=", v <= t)):
                    p, n = (y[on][hit] == 1).sum(), (y[on][hit] == 0).sum()
                    if p and p + n < len(v):
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, pick = gain, (name, op, float(t))
        if pick is None:
            break
        rule.append(pick)
        on &= _covers(x, [pick])
    return rule


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11) -> list[Rule]:
    """Ordered conjunctions for "drop" from statistics and their labels (1: drop)."""
    x, y, rules = _matrix(rows), bad.astype(int), []
    rng = np.random.default_rng(seed)
    while len(rules) < MOST_RULES and (y == 1).sum() >= 6:
        part = rng.random(len(y)) < 2 / 3
        if not (y[part] == 1).any() or not (y[~part] == 1).any():
            break
        rule = _grow(x[part], y[part])

        def worth(r: Rule) -> float:
            hit = _covers(x[~part], r)
            p, n = (y[~part][hit] == 1).sum(), (y[~part][hit] == 0).sum()
            return (p - n) / (p + n) if p + n else -1.0

        options = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(options, key=lambda r: (worth(r), -len(r)), default=[])
        if not rule or (worth(rule) + 1) / 2 < LEAST_PRECISION:
            break
        rules.append(rule)
        left = ~_covers(x, rule)
        x, y = x[left], y[left]
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    drawn = marks.orderBy(F.xxhash64(F.lit("rules"), "l_id"), "l_id").limit(MOST_LABELLED)
    own = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("l_id"))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))  # bounded whatever repeats
    got = own.mapInArrow(_stat_rows, "doc_id bigint, quality int, " + ", ".join(f"{c} bigint" for c in COUNTS)).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("n_words", "ascending"), ("word_chars", "ascending")])
    rows = {c: got[c].to_numpy() for c in COUNTS}
    failed = (rows["n_words"] < 10) | (100 * rows["n_repeat_words"] > 20 * rows["n_words"])
    return learn({c: v[~failed] for c, v in rows.items()}, got["quality"].to_numpy()[~failed] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as ordered conditions; true keeps."""
    term = lambda t: feature(t[0]) >= F.lit(t[2]) if t[1] == ">=" else feature(t[0]) <= F.lit(t[2])
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, map(term, rule)), F.lit(False))
    return out.otherwise(F.lit(True))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row of `docs`."""
    rules = fit(docs, labels)
    base = COUNTS[:5]
    return with_statistics(docs).select("doc_id", *base, base_failed().alias("base_failed"), verdict(rules).alias("kept"))
