"""Benchmark decontamination on canonical templates.

Texts become template words: ASCII punctuation around a word is dropped, words without a letter but with a digit
are numbers, words that begin with a capital followed by a small letter are names, a listed set are units, all
others are themselves in small letters (A-Z and accented Latin ones). Windows of `WINDOW` words (a shorter item: all of its
words) are fingerprinted and hash-joined with the documents' windows by two keys: the template words, from `SHORTEST` words
and `LITERALS` plain ones on, and the exact words in small letters, whatever they are. A one-word item is thus found wherever that
word stands.

On each diagonal of a document and an item, slots must map one to one. Where one of the item's names or numbers meets several,
the diagonal is judged by maximal stretches of matched windows within which it meets one, and by all of its windows with equal slots
together. `LEAST` such windows, or all of an item's if it has fewer (by the template key or by either), make a hit. Where two of the
item's meet the same one, which speaks against a copy, stretches count in which the slots map one to one both ways, and it takes
`CLASHED` windows in a row, more than two windows' words side by side. A diagonal with equal slots only is a
verbatim copy, as are windows enough with equal slots of a diagonal that was split, others a re-parameterised one. Slots compare in
small letters; n_windows is of the diagonal with most.

Null and empty texts and items match nothing; repeated rows of a document or item give one row for each pair; null
doc_id or item_id rows are matched and reported as null; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, buffers, chunks, mix, text_column, windows
from .shared import fresh

WINDOW, LITERALS, LEAST, SHORTEST = 8, 4, 3, 5
CLASHED = WINDOW + 1
#: fixed values: words that stand for a unit
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml s ms min h hours hour minutes seconds days weeks years percent dollars euros pounds usd eur meters metres miles kilometers kilograms grams liters litres degrees celsius".split()  # noqa: SIM905
#: with more benchmark windows than this, documents' windows go through a shuffled join instead of a filter in the tasks
MOST_HELD = 2_000_000
TEXT_BYTES = 1 << 19  # of documents that are cut into windows at once: what is made for each byte of them takes 60 times that
MATCH = "key bigint, id bigint, at bigint, slots array<string>, size int, exact boolean"
RUN = "id bigint, item_id bigint, n bigint, same boolean"
_EXACT = U64(0x6A09E667F3BCC909)

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LETTER = _LOWER.copy()
_LETTER[65:91] = _LETTER[128:] = True


def _unit_hashes() -> np.ndarray:
    data, offs = buffers(pa.array([" ".join(u for u in UNITS if u not in ("in", "a", "m", "s", "h", "l", "g"))]))
    return np.sort(Words(data, offs).hashes())


_SLOT = {k: mix(np.array([k], np.uint64))[0] for k in (1, 2, 3)}


def _small(data: np.ndarray) -> np.ndarray:
    """Accented Latin capitals (two bytes from C3 80 on) made small; A-Z are folded by the fingerprints."""
    out, second = data.copy(), data[1:]
    at = np.flatnonzero((data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) + 1
    out[at] += 0x20
    return out


class Template:
    """Template words of a chunk: doc, hash, slot (0: plain), start, end."""

    def __init__(self, batch: pa.RecordBatch):
        data, offs = buffers(text_column(batch))
        words = Words(_small(data), offs)
        solid = np.concatenate([[0], np.cumsum(~_PUNCT[data])])
        keep = solid[words.end] > solid[words.start]
        start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
        if len(start):
            # the first and last byte that is not punctuation
            plain = np.flatnonzero(~_PUNCT[data])
            start, end = plain[np.searchsorted(plain, start)], plain[np.searchsorted(plain, end) - 1] + 1
        count = lambda kind: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(kind[data])]))
        h = words.hashes(start, end)
        self.plain = h.copy()
        slot = np.zeros(len(h), np.int8)
        if len(h):
            digits, letters, small = count(_DIGIT), count(_LETTER), count(_LOWER)
            first, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
            upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            slot[np.isin(h, _unit_hashes())] = 3
            slot[upper & (small > 0)] = 2
            slot[(digits > 0) & (letters == 0)] = 1
            for k, v in _SLOT.items():
                h[slot == k] = v
        self.data, self.doc, self.hash, self.slot, self.start, self.end = data, doc, h, slot, start, end
        self.cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))

    def windows(self, size: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        if exact:
            at, h = windows(self.plain, self.doc, size)
            return at, mix(h ^ _EXACT)
        at, h = windows(self.hash, self.doc, size)
        literal = np.concatenate([[0], np.cumsum(self.slot == 0)])
        rich = literal[at + size] - literal[at] >= LITERALS
        return at[rich], h[rich]

    def slots(self, at: int, size: int) -> list[str]:
        return [bytes(self.data[self.start[i] : self.end[i]]).decode("utf-8", "replace") for i in range(at, at + size) if self.slot[i]]


def _rows(template: Template, ids: pa.Array, found: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """MATCH rows of (size, exact, window index, fingerprint) tuples."""
    at = np.concatenate([a for _, _, a, _ in found])
    key = np.concatenate([h for _, _, _, h in found]).view(np.int64)
    slots = [template.slots(int(a), size) for size, _, x, _ in found for a in x]
    size, exact = (np.repeat([f[k] for f in found], [len(f[2]) for f in found]) for k in (0, 1))
    doc = template.doc[at]
    columns = [pa.array(key), ids.take(pa.array(doc)), pa.array(at - template.cut[doc]), pa.array(slots, pa.list_(pa.string())), pa.array(size, pa.int32()), pa.array(exact, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "id", "at", "slots", "size", "exact"])


def _item_windows(batches):
    for batch in chunks(batches):
        t = Template(batch)
        found = [(WINDOW, exact, *t.windows(WINDOW, exact)) for exact in (False, True)]
        for size in range(1, WINDOW):
            for exact in (False, True) if size >= SHORTEST else (True,):
                at, h = t.windows(size, exact)
                whole = np.diff(t.cut)[t.doc[at]] == size
                found.append((size, exact, at[whole], h[whole]))
        yield _rows(t, text_column(batch, "id").cast(pa.int64()), found)


def _document_windows(kinds: list[tuple[int, bool]], held: np.ndarray | None):
    def run(batches):
        for batch in chunks(batches, limit=TEXT_BYTES):
            t = Template(batch)
            found = []
            for size, exact in kinds:
                at, h = t.windows(size, exact)
                if held is not None and len(held):
                    near = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    at, h = at[held[near] == h], h[held[near] == h]
                found.append((size, exact, at, h))
            if any(len(a) for _, _, a, _ in found):
                yield _rows(t, text_column(batch, "id").cast(pa.int64()), found)

    return run


def longest(windows_: list[set], both_ways: bool = False) -> int:
    """The most windows of a stretch in which each item slot meets one document slot (`both_ways`: and is met by no other)."""
    best, first, clash = 0, 0, 0
    count: dict = {}  # (side, slot) -> slots it meets -> windows of the stretch

    def meetings(pairs: set):
        for x, y in pairs:
            yield (0, x), y
            if both_ways:
                yield (1, y), x

    for last, pairs in enumerate(windows_):
        for x, y in meetings(pairs):
            met = count.setdefault(x, {})
            met[y] = met.get(y, 0) + 1
            clash += met[y] == 1 and len(met) > 1
        while clash:
            for x, y in meetings(windows_[first]):
                met = count[x]
                met[y] -= 1
                if not met[y]:
                    del met[y]
                    clash -= len(met) > 0
            first += 1
        best = max(best, last + 1 - first)
    return best


def run_of(flags: list[bool]) -> int:
    """The longest run of true ones."""
    best = now = 0
    for flag in flags:
        now = now + 1 if flag else 0
        best = max(best, now)
    return best


def judged(hits: list[dict], of: int, of_template: int) -> tuple[int, bool] | None:
    """Windows and verbatim of a diagonal's matches, or None where they are no hit."""
    pairs: dict[int, set] = {}
    rich = set()
    for x in hits:
        # an exact match has the item's own slots
        sides = ([v.lower() for v in x[k]] for k in ("item_slots", "item_slots" if x["exact"] else "slots"))
        pairs.setdefault(x["item_at"], set()).update(zip(*sides))
        if not x["exact"]:
            rich.add(x["item_at"])
    every = set().union(*pairs.values())
    clashed = len({y for _, y in every}) < len(every)
    found = []
    for ats, held in ((sorted(pairs), of), (sorted(rich), of_template)):
        own = [pairs[k] for k in ats]
        verbatim = [all(x == y for x, y in p) for p in own]
        if clashed:
            need, n, equal = CLASHED, longest(own, True), run_of(verbatim)
        else:
            need, n, equal = min(LEAST, held), longest(own), sum(verbatim)
            if n < len(own):
                n = max(n, equal)
            elif equal < n:
                equal = 0
        if need and n >= need:
            found.append((n, equal >= need))
    return (max(n for n, _ in found), any(same for _, same in found)) if found else None


def _judged(batches):
    for batch in batches:
        rows = []
        for i in range(0, batch.num_rows, 256):
            rows += [(r["id"], r["item_id"], *v) for r in batch.slice(i, 256).to_pylist() if (v := judged(r["hits"], r["of"], r["of_template"]))]
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "item_id", "n", "same"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, verbatim for every document that holds a passage of an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(_item_windows, MATCH)
    items = items.withColumnRenamed("id", "item_id").withColumnRenamed("slots", "item_slots").withColumnRenamed("at", "item_at").distinct()
    keys = items.select("key").distinct()
    n = keys.count()
    held = np.sort(keys.toArrow()["key"].to_numpy().view(np.uint64)) if n <= MOST_HELD else None
    kinds = sorted((r.size, r.exact) for r in items.select("size", "exact").distinct().collect())  # at most twelve
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_document_windows(kinds, held), MATCH).drop("size", "exact")
    at = F.col("item_at")
    per_item = items.groupBy("item_id").agg(F.countDistinct(at).alias("of"), F.countDistinct(F.when(~F.col("exact"), at)).alias("of_template")).withColumnRenamed("item_id", "of_item")
    hits = own.join(items, "key").withColumn("diagonal", F.col("at") - at)
    runs = hits.groupBy("id", "item_id", "diagonal").agg(F.collect_set(F.struct("item_at", "exact", "item_slots", "slots")).alias("hits"))
    runs = runs.join(per_item, F.col("item_id").eqNullSafe(F.col("of_item"))).select("id", "item_id", "hits", "of", "of_template").mapInArrow(_judged, RUN)
    pair = runs.groupBy("id", "item_id").agg(F.max("n").alias("n_windows"), F.bool_or("same").alias("verbatim"))
    return pair.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns as they were.

    A row is known by a 64-bit digest of its doc_id and text, so rows of the same or a null doc_id with another text stay.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    own = fresh(docs, "leaking")
    bad = leaks(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(bad, row == F.col(own), "left_anti")
