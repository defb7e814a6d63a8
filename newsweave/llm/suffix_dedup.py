"""Repeated byte strings removed after a distributed, common-prefix-aware merge sort of suffixes.

A byte goes when a string of `LENGTH` (400) bytes covers it that also starts elsewhere, in the same text or another.

1. Texts are stored in chunks. For each start p of a 400-byte string its first 200 bytes pick an anchor (the least
   16-byte fingerprint, the rightmost of equals), so equal strings have their anchor at the same distance. Starts with
   the same anchor are an interval of at most 185; about one byte in ninety is an anchor.
2. Fingerprints of each anchor's next 216 bytes, which all its strings share, and of the string at each interval's
   first start are counted over the corpus. An anchor whose bytes occur once is done. Where an interval and the next
   both begin with a repeated string, all bytes between are covered and it is done as well. What is left are
   the ends of repeats; a second exchange adds the anchors anywhere that share their bytes.
3. The suffixes at these anchors (400 bytes, then the bytes before them backwards) are sorted within a chunk, dealt out
   by key ranges as front-coded runs, and merged by a loser tree that compares two suffixes only from the prefix
   they are known to share. Neighbours with 216 common bytes are one group; equal suffixes count together; the
   distinct ones of a group decide which starts of each interval are repeated.
4. Covered ranges go back to the chunks, which cut the bytes out. Positions are judged on the input.

A group with more than `MOST_GROUPED` members is not gathered: its members' strings are counted by fingerprint,
each start by itself, spread over all tasks.

With `passages`, words of passages that another document has too are counted as well, since `PASSAGE` (50) words are often
fewer bytes than `LENGTH`: each window of 50 words picks an anchor among its first `PLACES` words (the least fingerprint of four words), so a
passage has its anchors in both documents; the `SURELY` words from an anchor on, which all its windows share, are counted by fingerprint over
the documents. Every passage of 50 words is found; what is found has 36 at least.

Null and empty texts have no bytes; texts below 400 bytes keep all; repeated rows are texts of their own and lose what
they share; null doc_ids are reported as null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Fingerprints, Words, buffers, chunks, mix, text_column, windows
from .packed import pack, unpack, value
from .shared import stored

LENGTH, GRAM, WINDOW = 400, 16, 185
SHARED = LENGTH - WINDOW + 1  # bytes from an anchor on that all its strings hold
CHUNK_BYTES = 3 << 20
MOST_GROUPED = 20_000
PASSAGE, PLACES = 50, 15
SURELY = PASSAGE - PLACES + 1
CHUNK = "chunk bigint, doc_ids array<bigint>, lengths binary, text binary, places binary, keys binary, sample array<bigint>"
PART = "part bigint, chunk bigint, payload binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def anchors(data: np.ndarray, offs: np.ndarray, prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and last start of every interval, ascending; the last interval of a text ends with it."""
    lens = np.diff(offs)
    some = np.flatnonzero(lens >= LENGTH)
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    n = len(data) - GRAM + 1
    mask = U64((1 << max(1, int(n).bit_length())) - 1)
    at = np.arange(n)
    least = (prints.of(at, at + GRAM) & ~mask) | (mask - at.astype(np.uint64))
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = WINDOW - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    count = lens[some] - LENGTH + 1
    starts = np.repeat(offs[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    anchor = (mask - (least[starts] & mask)).astype(np.int64)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    return anchor[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]


def _follows(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the next interval goes on where each ends."""
    return np.append(first[1:] == last[:-1] + 1, np.zeros(min(1, len(first)), bool))


def _chunk_rows(batches):
    part, nth = TaskContext.get().partitionId(), 0

    def made() -> pa.RecordBatch:
        keys = pa.chunked_array(ids).combine_chunks()
        data, lens = np.concatenate(texts), np.concatenate(lengths)
        prints = Fingerprints(data)
        anchor, first, last = anchors(data, np.concatenate([[0], np.cumsum(lens)]), prints)
        # an interval that no other follows within its text is closed by the text's last string
        ends = np.flatnonzero(~_follows(first, last) & (last > first))
        string, final = prints.of(first, first + LENGTH), prints.of(last[ends], last[ends] + LENGTH)
        own = prints.of(anchor, anchor + SHARED) ^ U64(0x5851F42D4C957F2D)
        sample = _prefixes(data, anchor[:: max(1, len(anchor) // 16)]) if len(anchor) else np.zeros(0, np.int64)
        columns = [
            pa.array([(part << 32) + nth]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            *(pa.array([x], pa.binary()) for x in (pack(lens), pack(data, level=5), pack(anchor, anchor - first, last - first, ends), pack(string, final, own))),
            pa.array([sample.tolist()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "lengths", "text", "places", "keys", "sample"])

    ids, texts, lengths, have = [], [], [], 0
    for batch in chunks(batches, limit=CHUNK_BYTES // 8):
        data, offs = buffers(text_column(batch))
        ids.append(text_column(batch, "doc_id").cast(pa.int64()))
        texts.append(data)
        lengths.append(np.diff(offs))
        have += len(data)
        if have >= CHUNK_BYTES:
            yield made()
            ids, texts, lengths, have, nth = [], [], [], 0, nth + 1
    if ids:
        yield made()


def _prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first seven bytes as a number that sorts like them."""
    out = np.zeros(len(at), np.int64)
    for k in range(7):
        out = (out << 8) | data[at + k]
    return out


def _by_range(chunk: int, parts: int, keys: np.ndarray, *beside: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Ascending distinct fingerprints, and arrays beside them, as rows by ranges."""
    cut = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(parts)], np.uint64))
    cut = np.append(cut, len(keys))
    return [(p, chunk, pack(keys[a:b], *(x[a:b] for x in beside))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "chunk", "payload"])


def _payloads(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    return zip(*(table.column(c).to_pylist() for c in ("part", "chunk", "payload")))


def _sent_keys(parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = np.unique(np.concatenate(unpack(value(batch, "keys", i))).astype(np.uint64), return_counts=True)
                yield from _table(_by_range(value(batch, "chunk", i), parts, keys, counts)).to_batches()

    return run


def _repeated(most_grouped: int):
    """For each key sent: how often it occurs in the corpus (0: once, 1: more often, 2: too often to gather)."""

    def run(table: pa.Table) -> pa.Table:
        sent = [(p, c, *unpack(x)) for p, c, x in _payloads(table)]
        _, at = np.unique(np.concatenate([k.astype(np.uint64) for _, _, k, _ in sent]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, _, _, n in sent]).astype(float))
        level = (total > 1).astype(np.uint8) + (total > most_grouped)
        cut = np.cumsum([0, *(len(k) for _, _, k, _ in sent)])
        return _table([(p, c, pack(level[at[a:b]])) for (p, c, _, _), a, b in zip(sent, cut[:-1], cut[1:])])

    return run


def _joined(table: pa.Table) -> np.ndarray:
    """What came back for a chunk's keys, in the order of the keys."""
    rows = sorted((p, x) for p, _, x in _payloads(table) if p >= 0)
    return np.concatenate([unpack(x)[0] for _, x in rows]) if rows else np.zeros(0, np.uint8)


def _open_ends(parts: int):
    """Splits a chunk's anchors: done, end of a repeat, or possible partner of one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        for i in range(left.num_rows):
            chunk = value(left, "chunk", i)
            anchor, back, span, ends = (x.astype(np.int64) for x in unpack(value(left, "places", i)))
            string, final, own = (x.astype(np.uint64) for x in unpack(value(left, "keys", i)))
            if not len(anchor):
                continue
            keys, at = np.unique(np.concatenate([string, final, own]), return_inverse=True)
            level = _joined(right)[at]
            first = anchor - back
            begins, finals, common = level[: len(anchor)] > 0, level[len(anchor) : len(anchor) + len(ends)] > 0, level[len(anchor) + len(ends) :]
            follows = _follows(first, first + span)
            closes = np.append(begins[1:], False) & follows
            # a text's last interval of one start is closed by its own string
            closes |= begins & ~follows & (span == 0)
            closes[ends] |= finals & ~follows[ends]
            inner = begins & closes
            stop = np.where(follows, np.append(first[1:], 0), first + span) + LENGTH
            maybe = np.flatnonzero(common == 1)
            group, of = np.unique(own[maybe], return_inverse=True)
            rows.append((-1 - chunk, chunk, pack(first[inner], stop[inner], np.flatnonzero(common > 0), common[common > 0], of)))
            rows += _by_range(chunk, parts, group, np.bincount(of, ~inner[maybe], len(group)) > 0)
        return _table(rows)

    return run


def _wanted(table: pa.Table) -> pa.Table:
    """Which groups of anchors hold an end of a repeat."""
    sent = [(p, c, x) for p, c, x in _payloads(table)]
    if sent[0][0] < 0:
        return table
    sent = [(p, c, *unpack(x)) for p, c, x in sent]
    _, at = np.unique(np.concatenate([k.astype(np.uint64) for _, _, k, _ in sent]), return_inverse=True)
    any_ = np.bincount(at, np.concatenate([e for _, _, _, e in sent]).astype(float)) > 0
    cut = np.cumsum([0, *(len(k) for _, _, k, _ in sent)])
    return _table([(p, c, pack(any_[at[a:b]].astype(np.uint8))) for (p, c, _, _), a, b in zip(sent, cut[:-1], cut[1:])])


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Ascending keys as the length shared with the key before, and the rest."""
    shared, rest, last = [], [], b""
    for key in keys:
        n = common(last, key, 0)
        shared.append(n)
        rest.append(key[n:])
        last = key
    return shared, rest


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys that share `known` bytes."""
    stop = min(len(a), len(b))
    if a[known:stop] == b[known:stop]:
        return stop
    while a[known : known + 32] == b[known : known + 32]:
        known += 32
    while a[known] == b[known]:
        known += 1
    return known


class Run:
    """A front-coded run, read one key at a time."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rest: bytes):
        self.shared, self.sizes, self.rest = shared.tolist(), sizes.tolist(), rest
        self.next, self.at, self.key = 0, 0, b""

    def step(self) -> int:
        """Make the next key current; the length it shares with the one before, or -1 at the end."""
        i = self.next
        if i == len(self.shared):
            return -1
        n, size = self.shared[i], self.sizes[i]
        self.key = self.key[:n] + self.rest[self.at : self.at + size]
        self.at += size
        self.next = i + 1
        return n


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, length shared with the key before) in ascending order of keys.

    Every loser remembers how much it shares with the key that beat it. Of two rivals the one that shares more with
    the last winner is smaller; only equals are compared, from there on.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    shared = [0] * k  # with the last winner
    alive = [False] * k
    for i, run in enumerate(runs):
        alive[i] = run.step() >= 0

    def play(a: int, b: int) -> tuple[int, int]:
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        left, right = runs[a].key, runs[b].key
        n = common(left, right, x)
        if left[n:] <= right[n:]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    tree = [0] * k
    best = list(range(k))
    size = k
    while size > 1:
        size //= 2
        following = []
        for j in range(size):
            winner, loser = play(best[2 * j], best[2 * j + 1])
            tree[size + j] = loser
            following.append(winner)
        best = following
    winner = best[0]
    while alive[winner]:
        run = runs[winner]
        yield winner, run.next - 1, shared[winner]
        n = run.step()
        alive[winner], shared[winner] = n >= 0, n
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def _suffix_runs(parts: int, borders: list[int]):
    """A chunk's wanted suffixes as front-coded runs by key ranges; strings of crowded groups by fingerprint."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        for i in range(left.num_rows):
            chunk = value(left, "chunk", i)
            data, lens = (unpack(value(left, c, i))[0] for c in ("text", "lengths"))
            anchor, back, span, _ = (x.astype(np.int64) for x in unpack(value(left, "places", i)))
            status = [x for p, _, x in _payloads(right) if p < 0]
            if not status:
                continue
            begin, stop, which, level, of = (x.astype(np.int64) for x in unpack(status[0]))
            maybe = which[level == 1]
            pick = maybe[_joined(right)[of] > 0] if len(maybe) else maybe
            offs = np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
            doc = np.searchsorted(offs, anchor[pick], "right") - 1
            raw = data.tobytes()
            keys = [raw[a : min(a + LENGTH, e)] + b"\xff" + raw[max(s, a - WINDOW + 1) : a][::-1] for a, s, e in zip(anchor[pick].tolist(), offs[doc].tolist(), offs[doc + 1].tolist())]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            to = np.searchsorted(np.array(borders, np.int64), _prefixes(data, anchor[pick[order]]), "right") if len(order) else np.zeros(0, np.int64)
            cut = np.searchsorted(to, np.arange(len(borders) + 2))
            for p in np.unique(to).tolist():
                own_order = order[cut[p] : cut[p + 1]]
                shared, rest = front_coded([keys[j] for j in own_order])
                rows.append((p, chunk, pack(np.array(shared), np.array([len(r) for r in rest]), np.frombuffer(b"".join(rest), np.uint8), anchor[pick[own_order]])))
            crowded = which[level == 2]
            if len(crowded):
                count = span[crowded] + 1
                at = np.repeat(anchor[crowded] - back[crowded] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                keys, where, times = np.unique(Fingerprints(data).of(at, at + LENGTH), return_inverse=True, return_counts=True)
                one = np.zeros(len(keys), np.int64)
                one[where] = at
                # strings that the chunk itself repeats are known; the others have one start here
                twice = at[times[where] > 1]
                begin, stop = np.concatenate([begin, twice]), np.concatenate([stop, twice + LENGTH])
                rows += [(parts + p, c, x) for p, c, x in _by_range(chunk, parts, keys, times, one)]
            rows.append((-1 - chunk, chunk, pack(begin, stop)))
        return _table(rows)

    return run


def _merged(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """Covered ranges of each chunk from the runs (or fingerprints) of one key range."""
        part = table.column("part")[0].as_py()
        if part < 0:
            return table
        if part >= parts:
            return _counted(table)
        sent = [(c, *unpack(x)) for _, c, x in _payloads(table)]
        runs = [Run(shared, sizes, rest.tobytes()) for _, shared, sizes, rest, _ in sent]
        groups: list[list] = []  # of [key, members]
        found = {c: ([], []) for c, *_ in sent}
        waiting = 0

        def settle() -> None:
            for (c, a), lo, hi in _decide(groups):
                found[c][0].append(a - hi)
                found[c][1].append(a - lo + LENGTH)
            groups.clear()

        for r, j, n in merge(runs):
            key, member = runs[r].key, (sent[r][0], int(sent[r][4][j]))
            if not groups or n < SHARED:
                if waiting >= 4096:
                    settle()
                    waiting = 0
                groups.append([[key, [member]]])
            elif n == len(key) == len(groups[-1][-1][0]):
                groups[-1][-1][1].append(member)
            else:
                groups[-1].append([key, [member]])
            waiting += 1
        settle()
        return _table([(part, c, pack(np.array(b, np.int64), np.array(e, np.int64))) for c, (b, e) in found.items() if b])

    return run


def _decide(groups: list[list]) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(member, least, greatest distance of a repeated start before its anchor) for members that have one."""
    open_: list[tuple[int, bytes, list]] = []
    for g, group in enumerate(groups):
        if len(group) > 1:
            open_ += [(g, key, members) for key, members in group]
        elif len(group[0][1]) > 1:
            open_.append((g, *group[0]))
    if not open_:
        return
    lefts = [key.index(b"\xff") for _, key, _ in open_]
    width = LENGTH + WINDOW - 1
    flat = np.zeros((len(open_), width), np.uint8)  # each text from WINDOW - 1 bytes before the anchor on
    right, left = np.array(lefts), np.array([len(key) - n - 1 for (_, key, _), n in zip(open_, lefts)])
    for i, ((_, key, _), n) in enumerate(zip(open_, lefts)):
        before = key[n + 1 :][::-1]
        flat[i, WINDOW - 1 - len(before) : WINDOW - 1 + n] = np.frombuffer(before + key[:n], np.uint8)
    d = np.arange(WINDOW)
    fits = (d[None, :] <= left[:, None]) & (LENGTH - d[None, :] <= right[:, None])
    row, dist = np.nonzero(fits)
    at = row * width + WINDOW - 1 - dist
    tag = mix(np.array([g for g, _, _ in open_], np.uint64)[row] * U64(WINDOW) + dist.astype(np.uint64) + U64(1))
    _, same = np.unique(Fingerprints(flat.ravel()).of(at, at + LENGTH) ^ tag, return_inverse=True)
    members = np.array([len(m) for _, _, m in open_])
    hit = np.bincount(same, members[row])[same] > 1
    row, dist = row[hit], dist[hit]
    cut = np.searchsorted(row, np.arange(len(open_) + 1))
    for i, (_, _, own) in enumerate(open_):
        if cut[i] < cut[i + 1]:
            lo, hi = int(dist[cut[i]]), int(dist[cut[i + 1] - 1])
            for member in own:
                yield member, lo, hi


def _counted(table: pa.Table) -> pa.Table:
    """Repeated strings of crowded groups: ranges for those that a chunk holds once."""
    sent = [(p, c, *unpack(x)) for p, c, x in _payloads(table)]
    _, at = np.unique(np.concatenate([h.astype(np.uint64) for _, _, h, _, _ in sent]), return_inverse=True)
    total = np.bincount(at, np.concatenate([n for _, _, _, n, _ in sent]).astype(float))
    cut, rows = np.cumsum([0, *(len(h) for _, _, h, _, _ in sent)]), []
    for (p, c, _, _, start), a, b in zip(sent, cut[:-1], cut[1:]):
        begin = start[total[at[a:b]] > 1].astype(np.int64)
        rows.append((p, c, pack(begin, begin + LENGTH)))
    return _table(rows)


def passage_anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and fingerprint of the `SURELY` words from every anchor of a 50-word window on."""
    words = Words(data, offs)
    plain = words.hashes(fold=False)
    start = np.flatnonzero(words.doc[: max(0, len(words) - PASSAGE + 1)] == words.doc[PASSAGE - 1 :])
    if not len(start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at, gram = windows(plain, np.zeros(len(plain), np.int64), 4)
    mask = U64((1 << max(1, len(at).bit_length())) - 1)
    least = (gram & ~mask) | (mask - at.astype(np.uint64))
    size = 1
    while size * 2 <= PLACES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (PLACES - size)], least[PLACES - size :])
    anchor = np.unique((mask - (least[start] & mask)).astype(np.int64))
    at, key = windows(plain, words.doc, SURELY)
    return words.doc[anchor], anchor - words.cut[words.doc[anchor]], key[np.searchsorted(at, anchor)]


def _sent_passages(parts: int):
    """Fingerprints of each chunk's passages, and in how many of its documents they are."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, lens = unpack(value(batch, "text", i))[0], unpack(value(batch, "lengths", i))[0].astype(np.int64)
                doc, _, key = passage_anchors(data, np.concatenate([[0], np.cumsum(lens)]))
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                once = np.ones(len(key), bool)
                once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                keys, counts = np.unique(key[once], return_counts=True)
                yield from _table(_by_range(value(batch, "chunk", i), parts, keys, counts)).to_batches()

    return run


def _shared_words(data: np.ndarray, offs: np.ndarray, table: pa.Table) -> np.ndarray:
    """Words of each row that stand in passages of other documents."""
    doc, word, key = passage_anchors(data, offs)
    keys, at = np.unique(key, return_inverse=True)
    hit = _joined(table)[at] > 0 if len(keys) else np.zeros(0, bool)
    doc, word = doc[hit], word[hit]
    # the anchors ascend within a row: each adds what it reaches beyond the one before
    step = np.full(len(word), SURELY)
    near = np.flatnonzero((doc[1:] == doc[:-1]) & (word[1:] - word[:-1] < SURELY)) + 1
    step[near] = word[near] - word[near - 1]
    return np.bincount(doc, step, len(offs) - 1).astype(np.int64)


def _with_passages(left: pa.Table, right: pa.Table) -> pa.Table:
    """The same with the words of passages; the passages' rows have parts from `_PASSAGES` on."""
    shared = [p >= _PASSAGES for p in right["part"].to_pylist()]
    out = _removed(left, right.filter(pa.array([not s for s in shared], pa.bool_())))
    rows, counts = right.filter(pa.array(shared, pa.bool_())), []
    for i in range(left.num_rows):
        data, lens = unpack(value(left, "text", i))[0], unpack(value(left, "lengths", i))[0].astype(np.int64)
        counts.append(_shared_words(data, np.concatenate([[0], np.cumsum(lens)]), rows))
    return out.append_column("n_shared_words", pa.array(np.concatenate([np.zeros(0, np.int64), *counts])))


_PASSAGES = 1 << 40


def _removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk without the covered bytes."""
    out: list[list] = [[], [], [], [], []]
    for i in range(left.num_rows):
        data, lens = unpack(value(left, "text", i))[0], unpack(value(left, "lengths", i))[0].astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(lens)])
        ranges = [unpack(x) for _, _, x in _payloads(right)]
        begin, stop = (np.concatenate([r[k].astype(np.int64) for r in ranges] or [np.zeros(0, np.int64)]) for k in (0, 1))
        edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
        gone = np.cumsum(edge[:-1]) > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offs[:-1][offs[:-1] < len(data)]
        starts[inner] = gone[inner]
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
        out[0] += value(left, "doc_ids", i)
        out[1] += lens.tolist()
        out[2] += total(gone).tolist()
        out[3] += total(starts).tolist()
        out[4] += [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
    return pa.Table.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, most_grouped: int = MOST_GROUPED, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs` (doc_id, text); with `passages` also n_shared_words."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunk_rows, CHUNK), "repeats-chunks")
    shares = [i / parts for i in range(1, parts)]
    borders = rows.select(F.explode("sample").alias("s")).agg(F.percentile_approx("s", shares)).first()[0] if shares else []
    borders = sorted(set(borders or []))
    counted = rows.select("chunk", "keys").mapInArrow(_sent_keys(parts), PART).groupBy("part").applyInArrow(_repeated(most_grouped), PART)
    ends = rows.select("chunk", "places", "keys").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_open_ends(parts), PART)
    wanted = ends.groupBy("part").applyInArrow(_wanted, PART)
    runs = rows.select("chunk", "lengths", "text", "places").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_suffix_runs(parts, borders), PART)
    ranges = runs.groupBy("part").applyInArrow(_merged(parts), PART)
    texts = rows.select("chunk", "doc_ids", "lengths", "text").groupBy("chunk")
    if not passages:
        return texts.cogroup(ranges.groupBy("chunk")).applyInArrow(_removed, RESULT)
    shared = rows.select("chunk", "lengths", "text").mapInArrow(_sent_passages(parts), PART).groupBy("part").applyInArrow(_repeated(1 << 62), PART)
    both = ranges.unionByName(shared.withColumn("part", F.col("part") + _PASSAGES))
    return texts.cogroup(both.groupBy("chunk")).applyInArrow(_with_passages, RESULT + ", n_shared_words bigint")
