"""Exact and fuzzy duplicates of entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from newsweave.sources.places import kept

from .graph import greedy_drops

ORDER = ("feed_ord", "entry_ord")
#: a fuzzy ratio of 95 or more: 2 * LCS of at least 95 % of both lengths
ALIKE, OF = 95, 100


def first_seen(entries: DataFrame, key: str = "link", order: Sequence[str] = ORDER) -> DataFrame:
    """The first entry of every non-empty link, before any other filter. One shuffle by link."""
    full = entries.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return full.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def not_stored(entries: DataFrame, stored: DataFrame, key: str = "link") -> DataFrame:
    """Entries whose key is in no stored row."""
    return entries.join(stored.select(key).distinct(), key, "left_anti")


def _same_start(a: str, b: str) -> int:
    """Number of characters that two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bit-parallel recurrence on what lies between common beginning and end."""
    start = _same_start(a, b)
    a, b = a[start:], b[start:]
    end = _same_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def _spread(titles: pd.Series, classes: int) -> np.ndarray:
    """How many characters of each title fall into each class (by code point)."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    return np.bincount(row * classes + codes % classes, minlength=classes * len(titles)).reshape(-1, classes)


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    # every character that one has more often is left out
    out = np.abs(_spread(a, 64) - _spread(b, 64)).sum(1)
    return pd.Series([OF * o <= (OF - ALIKE) * (len(x) + len(y)) and 2 * OF * common_subsequence(x, y) >= ALIKE * (len(x) + len(y)) for x, y, o in zip(a, b, out)], dtype=bool)


#: characters of a piece: of titles shorter than `LONG`, and of the others
SHORT_PIECE, PIECE, LONG = 5, 8, 40
#: from one piece to the next in a title of 80 characters
STEP = 9
#: pairs of rows looked at in one go; a piece held by so many pairs of rows is taken as a whole
_PAIRS, _MANY = 1 << 20, 1 << 12


#: counts modulo eight as four bits, of which neighbours differ in one
_RING = np.array([0, 1, 3, 7, 15, 14, 12, 8], np.uint64)


@F.pandas_udf(LongType())
def letters(titles: pd.Series) -> pd.Series:
    """How many characters of a title fall into each of 16 classes (by code point), on a ring of eight: an edit changes one bit."""
    return pd.Series((_RING[_spread(titles, 16) & 7] << np.arange(0, 64, 4, dtype=np.uint64)).sum(1).astype(np.int64))


def _near(long: dict[str, np.ndarray], short: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """id, l_id of the pairs of rows i, j that may be alike and meet here first."""
    n, l_n, a, b = long["n"][i], short["n"][j], long["id"][i], short["id"][j]
    edits, shift = (n + l_n) // 20, long["at"][i] - short["at"][j]
    fits = ((l_n < n) | ((l_n == n) & (b < a))) & (n - l_n <= edits) & (np.abs(shift) + np.abs(n - l_n - shift) <= edits)
    fits &= (np.bitwise_count(long["letters"][i] ^ short["letters"][j]) <= edits) & (long["before"][i] != short["before"][j])
    a, b = a[fits], b[fits]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id", "l_id"])


def _met(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What meets among rows sorted by gram, whole grams only."""
    long, short = ({c: v[rows["is_long"] == own] for c, v in rows.items()} for own in (True, False))
    grams, first, n_long = np.unique(long["gram"], return_index=True, return_counts=True)
    begin = np.searchsorted(short["gram"], grams)
    n_short = np.searchsorted(short["gram"], grams, "right") - begin
    many = n_long * n_short >= _MANY
    # blocks of a gram's rows against each other: nothing is made of a pair but its difference in letters
    for at, have, l_at, l_have in zip(first[many], n_long[many], begin[many], n_short[many]):
        theirs = short["letters"][l_at : l_at + l_have]
        for l_start in range(0, l_have, _PAIRS):
            part = theirs[l_start : l_start + _PAIRS]
            step = max(1, _PAIRS // len(part))
            for start in range(at, at + have, step):
                own = slice(start, min(start + step, at + have))
                # the shorter title allows no more edits than the longer one against itself
                i, j = np.nonzero(np.bitwise_count(long["letters"][own, None] ^ part) <= (long["n"][own, None] // 10))
                yield _near(long, short, i + start, j + l_at + l_start)
    # the others row by row of the longer titles, many grams in one go
    few = ~many & (n_short > 0)
    own = np.repeat(first[few], n_long[few]) + _counted(n_long[few])
    l_at, l_have = np.repeat(begin[few], n_long[few]), np.repeat(n_short[few], n_long[few])
    # a gram has less than _MANY pairs, so a stretch has few more than _PAIRS
    cuts = np.searchsorted(np.cumsum(l_have), np.arange(0, l_have.sum() + _PAIRS, _PAIRS), "right")
    for start, stop in zip(cuts[:-1], cuts[1:]):
        have = l_have[start:stop]
        yield _near(long, short, np.repeat(own[start:stop], have), np.repeat(l_at[start:stop], have) + _counted(have))


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, l_id of what meets among rows in the order of their grams; only the rows of the last gram are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.searchsorted(batch["gram"].to_numpy(), batch["gram"][-1].as_py())
        if last or (held and held[-1]["gram"][-1] != batch["gram"][-1]):
            yield from _met(_columns([*held, batch[:last]]))
            held = []
        held.append(batch[last:])
    if held:
        yield from _met(_columns(held))


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    # bits are counted of unsigned numbers
    return {c: table[c].to_numpy().view(np.uint64) if c == "letters" else table[c].to_numpy() for c in table.column_names}


def meeting(sized: DataFrame) -> DataFrame:
    """id, l_id (id before l_id) of the pairs that may be alike, among them all that are. `sized`: id, title, n (its length), letters.

    An alike pair has at most floor(0.05 (la + lb)) edits, characters left out of either, so at most floor(0.1 la) where a is the longer. Of one
    piece more than that, cut from the longer title, one stands whole in the other, shifted by no more than the edits. The longer
    titles' pieces, spread evenly, meet all places of the shorter ones; a pair that meets and whose letter
    counts are no further apart than the edits allowed goes on to the exact ratio. The exchanges carry a fixed number of short rows a
    title; what meets is counted off within the tasks, on arrays, and written nowhere. A pair that met on the piece `STEP` before, at the same
    shift, is not named again. No alike pair is lost, but for a clash of two 64-bit hashes there.
    """
    size = f"if(n < {LONG}, {SHORT_PIECE}, {PIECE})"
    # as many pieces as edits and one, the first at the beginning and the last at the end
    cut_at = lambda i: f"1 + (({i}) * (n - {size})) div (n div 10)"
    gram = lambda at, size: f"xxhash64(substring(title, {at}, {size}))"
    # what lies one step before: 0 and 1 are unlike each other and stand for nothing to compare
    before = f"if(i > 0 and {cut_at('i')} - {STEP} = {cut_at('i - 1')}, {gram(f'{cut_at("i")} - {STEP}', size)}, 0L)"
    longer = sized.select("id", "n", "letters", F.lit(True).alias("is_long"), F.expr(f"inline(transform(sequence(0, n div 10), i -> struct(cast({cut_at('i')} as int) as at, {gram(cut_at('i'), size)} as gram, {before} as before)))"))
    # a title may be the shorter one of two in both sizes of pieces
    places = lambda size: f"transform(sequence(1, n - {size - 1}), p -> struct(p as at, {gram('p', size)} as gram, if(p > {STEP}, {gram(f'p - {STEP}', size)}, 1L) as before))"
    shorter = [sized.filter(where).select("id", "n", "letters", F.lit(False).alias("is_long"), F.expr(f"inline({places(size)})")) for where, size in ((f"n >= {LONG * 19 // 21}", PIECE), (f"n < {LONG}", SHORT_PIECE))]
    rows = longer.unionByName(shorter[0]).unionByName(shorter[1]).withColumn("id", F.col("id").cast("bigint"))
    # gram by gram in sorted runs
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_meet, "id bigint, l_id bigint").distinct()


def near_pairs(titles: DataFrame) -> DataFrame:
    """a, b (ids, a before b) of all pairs whose titles are alike. `titles`: id (bigint), title (distinct titles)."""
    # shorter ones allow no edit
    sized = kept(titles.select("id", "title", F.length("title").alias("n"), letters("title").alias("letters")).filter("n >= 10"), "sized")
    met = meeting(sized)
    own = sized.select("id", "title")
    pairs = met.join(own, "id").join(own.select(F.col("id").alias("l_id"), F.col("title").alias("l_title")), "l_id")
    return pairs.filter(alike("title", "l_title")).select(F.col("id").alias("a"), F.col("l_id").alias("b"))


def fuzzy_first(entries: DataFrame, title: str = "title", order: Sequence[str] = ORDER) -> DataFrame:
    """Entries kept when each, in order, is dropped if its title is alike to an earlier kept one.

    Equal normalised titles are settled by a window. Alike titles form a graph whose components are settled each for itself.
    """
    norm = F.lower(F.regexp_replace(F.col(title), r"(?U)^\s+|\s+$", ""))
    placed = entries.withColumn("_norm", F.coalesce(norm, F.lit("")))
    first = placed.withColumn("_nth", F.row_number().over(W.partitionBy("_norm").orderBy(*order))).filter("_nth = 1").drop("_nth")
    # sorted by ranges, so the numbers ascend in the given order
    once = kept(first.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "titles")
    gone = greedy_drops(near_pairs(once.select(F.col("_id").alias("id"), F.col("_norm").alias("title"))))
    return once.join(gone.withColumnRenamed("id", "_id"), "_id", "left_anti").drop("_norm", "_id")


def ratio(a: str, b: str) -> float:
    """The fuzzy ratio of two titles, 0 to 100; two empty titles are alike."""
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def greedy(titles: Sequence[str]) -> np.ndarray:
    """Which titles stay when taken one by one: the definition, for tests and small lists."""
    kept: list[str] = []
    out = np.zeros(len(titles), bool)
    for i, t in enumerate(titles):
        if all(ratio(t, k) < ALIKE for k in kept):
            kept.append(t)
            out[i] = True
    return out
