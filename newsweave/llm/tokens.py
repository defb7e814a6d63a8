"""Token ids of texts by the `tokenizers` library, fast on repeated words.

A byte-level tokenizer encodes each piece of its pre-tokenizer by itself, so a chunk is cut into pieces with
vectorised class tests (letters, numbers, white space, the rest, and the short contractions), equal pieces are
encoded once by the library and the ids are gathered. A bounded cache of pieces outlives a chunk and, as workers are
reused, a task. The library gets many pieces in one text, with a byte between them that UTF-8 never has and that the
vocabulary merges with nothing; a vocabulary without such a byte gets them one by one.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .arrays import U64, Fingerprints, buffers

MOST_CACHED = 800_000
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
JOINED = 1 << 13  # bytes of pieces that the library gets in one text
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves


def _alphabet() -> np.ndarray:
    """The code points as which byte-level vocabularies write the 256 bytes."""
    out = np.zeros(256, "<u4")
    out[_SHOWN] = _SHOWN
    other = np.setdiff1d(np.arange(256), _SHOWN)
    out[other] = 256 + np.arange(len(other))
    return out


ALPHABET = _alphabet()


def default_tokenizer() -> str:
    """Where the public byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _newer(split) -> tuple[list[int], list[int]]:
    """Letters and numbers among the characters that Python's tables do not know, as the pre-tokenizer takes them.

    Each stands between a letter and a digit: it is of the class whose piece it joins.
    """
    letters, numbers = [], []
    for first in range(0, 0x40000, 1 << 12):  # at once the library's pieces would take a worker 79 MB and more
        unknown = [cp for cp in range(first, first + (1 << 12)) if unicodedata.category(chr(cp)) == "Cn"]
        begins = {a for _, (a, _) in split("".join(f"a{chr(cp)}1" for cp in unknown))}
        letters += [cp for k, cp in enumerate(unknown) if 3 * k + 1 not in begins]
        numbers += [cp for k, cp in enumerate(unknown) if 3 * k + 2 not in begins]
    return letters, numbers


@cache
def _classes(path: str) -> np.ndarray:
    from tokenizers import Tokenizer

    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = LETTER if kind == "L" else NUMBER
    letters, numbers = _newer(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
    out[letters], out[numbers] = LETTER, NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return out


def pieces(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokenizer's pieces begin. `classes`: of every code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[cp]
    first = np.zeros(n, bool)
    edges = np.searchsorted(at, offs)
    first[edges[:-1][edges[:-1] < n]] = True
    white = kind == WHITE
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~first[1:]
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start = np.where(white, new | last, new & ~blank_before)
    # 's 't 'm 'd and 're 've 'll are pieces of their own where a piece begins at the apostrophe
    quote = np.flatnonzero(start & (cp == 39))
    if len(quote):
        stop = edges[1:][np.searchsorted(edges, quote, "right") - 1]
        get = lambda i: np.where(i < stop, cp[np.minimum(i, n - 1)], 0)
        a, b = get(quote + 1), get(quote + 2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, k in ((one, 2), (two & ~one, 3)):
            q, s = quote[hit], stop[hit]
            start[q + 1] = False
            q = q[q + k < s]
            start[q + k] = True
    return at[start]


def _mark(tokenizer) -> int | None:
    """A byte between pieces that leaves their ids as they are, or None if there is none."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    model, pre = tokenizer.model, tokenizer.pre_tokenizer
    if not isinstance(model, BPE) or not isinstance(pre, ByteLevel) or pre.add_prefix_space or tokenizer.normalizer is not None:
        return None
    if model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges:
        return None
    if not all(t.special for t in tokenizer.get_added_tokens_decoder().values()):
        return None  # others are found within pieces
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    if not all(chr(c) in vocab for c in ALPHABET.tolist()):
        return None
    merged = set("".join(token for token in vocab if len(token) > 1))
    return next((b for b in (*range(0xF5, 0x100), 0xC0, 0xC1) if chr(ALPHABET[b]) not in merged), None)


class Places:
    """Counting numbers of 64-bit fingerprints, in the order in which they are added; at most half of the slots are taken."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.place, self.used = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), 0

    def __len__(self) -> int:
        return self.used

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it was not added."""
        mask = len(self.keys) - 1
        slot = (keys & U64(mask)).view(np.int64)
        out = self.place.take(slot)
        open_ = np.flatnonzero((self.keys.take(slot) != keys) & (out >= 0))
        while len(open_):
            slot[open_] = own = (slot[open_] + 1) & mask
            out[open_] = found = self.place.take(own)
            open_ = open_[(self.keys.take(own) != keys[open_]) & (found >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add different keys, none of which was added before."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            taken = np.flatnonzero(self.place >= 0)
            had = np.empty(self.used, np.uint64)
            had[self.place[taken]] = self.keys[taken]
            del taken
            self.__init__(1 << (2 * (len(had) + len(keys))).bit_length())
            for i in range(0, len(had), 1 << 16):  # what is made to place a key takes more than the key
                self._put(had[i : i + (1 << 16)])
        self._put(keys)

    def _put(self, keys: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & U64(mask)).view(np.int64)
        left, places = np.arange(len(keys)), np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.used += len(keys)
        while len(left):
            free = left[self.place[slot[left]] < 0]
            self.place[slot[free]] = places[free]  # one of those that want the same slot stays
            stays = free[self.place[slot[free]] == places[free]]
            self.keys[slot[stays]] = keys[stays]
            left = left[self.place[slot[left]] != places[left]]
            slot[left] = (slot[left] + 1) & mask


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a larger copy, with places for `more` values after those used."""
    return x if used + more <= len(x) else np.concatenate([x[:used], np.zeros(max(more, len(x)), x.dtype)])


class Encoder:
    """encode(column) gives the flat ids of all rows and each row's number of ids.

    With `special_as_text` the strings of special tokens in a text are ordinary text; otherwise the library's
    default holds and they become their ids.
    """

    def __init__(self, path: str | None = None, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_tokenizer()
        self.tokenizer, self.classes = Tokenizer.from_file(path), _classes(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.mark = _mark(self.tokenizer)
        self.joined = None if self.mark is None else Tokenizer(self.tokenizer.model)
        self.special = [] if special_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Start with an empty cache: the pieces' fingerprints, and where each one's ids begin and how many they are."""
        self.keys, self.begin, self.length = Places(), np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces, flat, and how many each has."""
        if self.joined is None:
            raw = data.tobytes()
            lists = self._lists(self.tokenizer, [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())])
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int32, len(lists))
        size = end - start + 1
        stop = np.cumsum(size)
        source = np.repeat(start - (stop - size), size) + np.arange(stop[-1])
        source[stop - 1] = 0
        chars = ALPHABET[data[source]]
        chars[stop - 1] = ALPHABET[self.mark]
        text = chars.tobytes().decode("utf-32-le")
        last = np.append(np.flatnonzero(np.diff(stop // JOINED)), len(stop) - 1)
        cuts = [0, *stop[last].tolist()]
        flat = np.fromiter(chain.from_iterable(self._lists(self.joined, [text[a:b] for a, b in zip(cuts, cuts[1:])])), np.uint32)
        between = flat == self.joined.token_to_id(chr(ALPHABET[self.mark]))
        return flat[~between], (np.diff(np.flatnonzero(between), prepend=-1) - 1).astype(np.int32)

    @staticmethod
    def _lists(tokenizer, texts: list[str]) -> list[list[int]]:
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        have, to = len(self.keys), len(self.keys) + len(keys)
        self.ids, self.length, self.begin = _room(self.ids, self.used, len(flat)), _room(self.length, have, len(keys)), _room(self.begin, have, len(keys))
        self.ids[self.used : self.used + len(flat)] = flat
        self.keys.add(keys)
        self.length[have:to] = lens
        self.begin[have:to] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = buffers(column)
        start = pieces(data, offs, self.classes)
        if len(self.keys) > MOST_CACHED:
            self.forget()
        end = np.append(start[1:], len(data))
        prints = Fingerprints(data).of(start, end)
        index = self.keys.find(prints)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            unique, where, which = np.unique(prints[missing], return_index=True, return_inverse=True)
            index[missing] = len(self.keys) + which
            where = missing[where]
            self._add(unique, *self._encode_pieces(data, start[where], end[where]))
        lens = self.length[index].astype(np.int64)
        stop = np.cumsum(lens)
        flat = self.ids[np.repeat(self.begin[index] - (stop - lens), lens) + np.arange(stop[-1] if len(stop) else 0)]
        per_row = np.diff(np.concatenate([[0], stop])[np.searchsorted(start, offs)])
        return self._with_special(column, data, flat, per_row)

    def _with_special(self, column: pa.Array, data: np.ndarray, flat: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if self.special else b""
        if not any(s in raw for s in self.special):
            return flat, per_row
        cut = np.concatenate([[0], np.cumsum(per_row)])
        parts = []
        for i, text in enumerate(column.to_pylist()):
            own = flat[cut[i] : cut[i + 1]]
            if text and any(s.decode() in text for s in self.special):
                own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            parts.append(own)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def with_end(flat: np.ndarray, per_row: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each row."""
    stop = np.cumsum(per_row)
    return np.insert(flat, stop, np.uint32(end)), per_row + 1


@cache
def encoder(path: str | None, special_as_text: bool) -> Encoder:
    """The worker's own encoder."""
    return Encoder(path, special_as_text)
