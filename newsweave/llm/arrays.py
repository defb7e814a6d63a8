"""Vectorised text primitives over the buffers of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these never cut a character.
A word's fingerprint is a polynomial hash of its bytes (A-Z folded to a-z), finished by a mixer; five words
combine into a shingle. Everything works on chunks of a few megabytes, so memory is bounded by the chunk
and the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 3 << 19
CHUNK_ROWS = 8192
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Hand freed memory back to the system, as workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with at most `limit` bytes of text each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + CHUNK_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets from 0; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Fingerprints:
    """64-bit fingerprints of byte spans, from one running sum; with `fold`, A-Z count as a-z."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Words:
    """Word spans of a chunk: start, end (byte offsets), doc (row) and cut (row -> first word index)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        self.data, self.offs = data, offs
        inside = np.zeros(n + 1, bool)
        np.logical_not(SPACE[data], out=inside[:n])
        begins, ends = inside[:n].copy(), np.zeros(n + 1, bool)
        begins[1:] &= ~inside[: n - 1] if n else begins[1:]
        ends[1:] = inside[:n] & ~inside[1:]
        edge = offs[:-1][offs[:-1] < n]
        begins[edge] = inside[edge]
        inner = edge[edge > 0]
        ends[inner] = inside[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.cut = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.cut))
        self._prints: dict[bool, Fingerprints] = {}

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, fold: bool = True) -> np.ndarray:
        """Fingerprints of byte spans (by default the words)."""
        if fold not in self._prints:
            self._prints[fold] = Fingerprints(self.data, fold)
        return self._prints[fold].of(self.start if start is None else start, self.end if end is None else end)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and fingerprint of every `size`-word window that stays within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += hashes[j : j + n] * _PLACE[j % 64]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix(h[at] + U64(size))


def short_hash(hashes: np.ndarray) -> int:
    """Fingerprint of a whole word sequence shorter than a window."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(hashes * _PLACE[: len(hashes)], dtype=np.uint64) + U64(len(hashes))], np.uint64))[0])


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of all shingles, repeats included; a row with fewer words gives its whole sequence."""
    wh = words.hashes()
    at, h = windows(wh, words.doc, size)
    row = words.doc[at]
    count = np.diff(words.cut)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        extra = np.array([short_hash(wh[words.cut[r] : words.cut[r + 1]]) for r in few], np.uint64)
        row, h = np.concatenate([row, few]), np.concatenate([h, extra])
    return row, h


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
