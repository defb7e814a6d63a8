"""Elias-Fano sequences and a three-level n-gram trie in one flat, memory-mapped buffer.

A sequence of n ascending integers below u keeps floor(log2(u / n)) low bits of each packed, and the high parts in
unary, about two bits an element. A successor search jumps to the bucket of a value's high part and compares low
bits within it.

The trie's first level holds contexts (the last word), its second their successors and, separately, the words before
them, its third the successors of both words. A third-level word is stored relative to its context: as its place among
the second-level successors. The children of a node form a range; pointers to the ranges are monotone, and a range's
ids are made monotone by the last value of the range before, so both are Elias-Fano sequences. Probabilities and
backoff weights are eight-bit codes of their negative logarithms.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np

STEPS = 24  # codes for each unit of log10
LOW_LIMIT = 57
_HEAD = struct.Struct("<QQQ")


def encode_sequence(values: np.ndarray, universe: int) -> bytes:
    """`values`: ascending, below `universe` (at most 2**57)."""
    n = len(values)
    values = values.astype(np.uint64)
    low_bits = max(0, min(LOW_LIMIT, (universe // n).bit_length() - 1)) if n else 0
    parts = []
    for at in range(0, n, 1 << 18):
        bits = np.unpackbits(values[at : at + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts.append(np.packbits(bits[:, :low_bits].ravel(), bitorder="little"))
    low = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    high = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
    high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    packed = np.packbits(high, bitorder="little")
    words = -(-len(low) // 8) + 2  # a low part may be read across two words
    return _HEAD.pack(n, low_bits, len(high)) + low.tobytes().ljust(8 * words, b"\0") + packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0")


class Sequence:
    """View of an encoded sequence; `size` is the bytes it takes from the buffer."""

    def __init__(self, buffer: np.ndarray):
        self.n, bits, total = _HEAD.unpack_from(buffer[: _HEAD.size].tobytes())
        self.bits = np.uint64(bits)
        words = -(-(-(-self.n * bits // 8)) // 8) + 2
        at = _HEAD.size
        self.low = buffer[at : at + 8 * words].view("<u8")
        at += 8 * words
        self.high = buffer[at : at + -(-total // 8)]
        self.total, self.size = total, at + -(-(-(-total // 8)) // 8) * 8
        self.mask = (np.uint64(1) << self.bits) - np.uint64(1)

    @cached_property
    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high, count=self.total, bitorder="little").view(bool)

    @cached_property
    def ones(self) -> np.ndarray:
        return np.flatnonzero(self._bits)

    @cached_property
    def start(self) -> np.ndarray:
        """Elements before each bucket of equal high parts."""
        zeros = np.flatnonzero(~self._bits)
        return np.concatenate([[0], zeros - np.arange(len(zeros))])

    @cached_property
    def values(self) -> np.ndarray:
        """All elements."""
        at = np.arange(self.n)
        return ((self.ones - at) << np.int64(self.bits)) | self._low(at).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        place = i.astype(np.uint64) * self.bits
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.ones[i] - i) << np.int64(self.bits)) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element at or above each x, and whether it equals x."""
        x = x.astype(np.uint64)
        high = np.minimum((x >> self.bits).astype(np.int64), len(self.start) - 2)
        low, stop, want = self.start[high], self.start[high + 1], x & self.mask
        end, live = stop.copy(), np.flatnonzero(low < stop)
        while len(live):
            a, b = low[live], stop[live]
            middle = (a + b) >> 1
            less = self._low(middle) < want[live]
            low[live] = np.where(less, middle + 1, a)
            stop[live] = np.where(less, b, middle)
            live = live[low[live] < stop[live]]
        equal = low < end
        at = np.flatnonzero(equal)
        equal[at] = self._low(low[at]) == want[at]
        return low, equal


def code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 255).astype(np.uint8)


def _ranges(node: np.ndarray, ids: np.ndarray, nodes: int) -> list[bytes]:
    """Pointers and monotone ids of children (sorted by node, then id)."""
    first = np.concatenate([np.searchsorted(node, np.arange(nodes)), [len(node)]])
    last = np.where(first[1:] > first[:-1], ids[first[1:] - 1] + 1, 0) if len(ids) else np.zeros(nodes, np.int64)
    base = np.cumsum(last) - last
    total = int(last.sum()) + 1
    return [encode_sequence(first, len(node) + 1), encode_sequence(base[node] + ids + 1 if len(ids) else ids, total)]


class Children:
    """One level: ranges of ids below nodes."""

    def __init__(self, sections: Iterator[np.ndarray]):
        self.pointers, self.ids = Sequence(next(sections)), Sequence(next(sections))

    def first(self, node: np.ndarray) -> np.ndarray:
        return self.pointers.access(node)

    def find(self, node: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index of the child `ids` of each `node`, or -1; a negative node or id has none."""
        out = np.full(len(node), -1, np.int64)
        ask = np.flatnonzero((node >= 0) & (ids >= 0))
        if not len(ask) or not self.ids.n:
            return out
        first, stop = self.first(node[ask]), self.first(node[ask] + 1)
        base = np.where(first > 0, self.ids.access(np.maximum(first - 1, 0)), 0)
        at, equal = self.ids.successor(base + ids[ask] + 1)
        out[ask] = np.where(equal & (at < stop), at, -1)
        return out


def _group(key: np.ndarray, trained: np.ndarray, total: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys that training knows, their training totals (`total` where it is not negative), and each token's place or -1."""
    own, of = np.unique(key, return_inverse=True)
    count = np.bincount(of, trained, len(own)).astype(np.int64)
    if total is not None:
        given = np.full(len(own), -1, np.int64)
        given[of] = total
        count = np.where(given >= 0, given, count)
    known = count > 0
    return own[known], count[known], np.where(known, np.cumsum(known) - 1, -1)[of]


def build(
    words: np.ndarray, counts: np.ndarray, context: np.ndarray, before: np.ndarray, word: np.ndarray, unigram: np.ndarray, strength: float,
    trained: np.ndarray | None = None, after_total: np.ndarray | None = None, both_total: np.ndarray | None = None,
) -> bytes:
    """The trie of counted trigrams.

    `words`: distinct fingerprints below 2**56, ascending, with `counts` in training; `context`, `before`, `word`: their indices for
    every token; `unigram`: each word's lowest-order probability; `trained`: which tokens count (default: all). A level's
    probability is (count + strength * lower level) / (count of its context + strength), so a context's sum to one. A word is followed by
    one token each time, so its count is that of its context. `after_total` and `both_total` have, for tokens whose context
    is spread over several tries, the corpus counts of (context, word) and (before, context); -1: all of them are here.
    """
    n = len(words)
    trained = np.ones(len(word), bool) if trained is None else trained
    context, before, word = (x.astype(np.int64) for x in (context, before, word))
    pair, pair_count, pair_of = _group(context * n + word, trained, after_total)
    two, two_count, two_of = _group(context * n + before, trained, both_total)
    nodes = np.unique(np.concatenate([pair // n, two // n]))
    node_of, two_node = np.searchsorted(nodes, pair // n), np.searchsorted(nodes, two // n)
    total = counts[nodes].astype(float)
    spread = strength / (total + strength)
    lower = (pair_count + strength * unigram[pair % n]) / (total[node_of] + strength)
    first = np.searchsorted(node_of, np.arange(len(nodes)))
    relative = pair_of - first[np.searchsorted(nodes, context).clip(0, max(0, len(nodes) - 1))] if len(nodes) else pair_of
    width = int(relative.max(initial=0)) + 1
    full_of = two_of[trained] * width + relative[trained]
    three, count = np.unique(full_of, return_counts=True)
    of = three // width
    two_spread = strength / (two_count + strength)
    full = (count + strength * lower[first[two_node[of]] + three % width]) / (two_count[of] + strength)
    logs = [code(np.log10(x)) for x in (spread, lower, two_spread, full)]
    sections = [encode_sequence(words, 1 << 56), encode_sequence(nodes, max(1, n))]
    sections += _ranges(node_of, pair % n, len(nodes)) + _ranges(two_node, two % n, len(nodes)) + _ranges(of, three % width, len(two))
    sections += [x.tobytes() for x in logs]
    sections = [s.ljust(-(-len(s) // 8) * 8, b"\0") for s in sections]
    return struct.pack(f"<Q{len(sections)}Q", len(sections), *map(len, sections)) + b"".join(sections)


class Trie:
    """Queries on a buffer made by `build`, such as a memory map of its file."""

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        count = int(raw[:8].view("<u8")[0])
        sizes = raw[8 : 8 + 8 * count].view("<u8").astype(np.int64)
        stop = 8 + 8 * count + np.cumsum(sizes)
        sections = iter([raw[b - s : b] for s, b in zip(sizes, stop)])
        self.words, self.nodes = Sequence(next(sections)), Sequence(next(sections))
        self.after, self.before, self.both = Children(sections), Children(sections), Children(sections)
        self.spread, self.lower, self.two_spread, self.full = sections

    def identify(self, fingerprints: np.ndarray) -> np.ndarray:
        at, equal = self.words.successor(fingerprints)
        return np.where(equal, at, -1)

    def node(self, ids: np.ndarray) -> np.ndarray:
        at, equal = self.nodes.successor(np.maximum(ids, 0))
        return np.where(equal & (ids >= 0), at, -1)

    def log10(self, node: np.ndarray, before: np.ndarray, word: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """Of each word id after (before, node's word); `unigram`: log10 of its lowest-order probability."""
        out = unigram.copy()
        known = np.flatnonzero(node >= 0)
        known = known[np.argsort(node[known] * (self.words.n + 1) + word[known])]  # neighbours in the trie are asked together
        node, before, word = node[known], before[known], word[known]
        child = self.after.find(node, word)
        seen = child >= 0
        costs = np.where(seen, self.lower[np.maximum(child, 0)], self.spread[node]) / -STEPS + np.where(seen, 0, out[known])
        two = self.before.find(node, before)
        old = np.flatnonzero(two >= 0)
        relative = np.where(seen[old], child[old] - self.after.first(node[old]), -1)
        three = self.both.find(two[old], relative)
        costs[old] = np.where(three >= 0, self.full[np.maximum(three, 0)] / -STEPS, costs[old] + self.two_spread[two[old]] / -STEPS)
        out[known] = costs
        return out
