"""Adaptive context-mixing range coder for token ids.

A block codes up to `BLOCK` ids and starts from a fresh model, so blocks are independent; each has a checksum. Within
a block the ids are dealt over up to `LANES` lanes (one after the other: each lane is a stretch of the block) that take
one step side by side in numpy. Every lane has a range coder and a history of its own; the model is shared and learns
from all lanes after each step, so it knows the whole block so far, not a lane.

Three orders speak for every id. Order 0 is a count of each id of the block. Order 1 (the previous id) and order 2
(the two previous ids) each hold a context's two leading ids with their trust. The prediction is the weighted sum of the
three: each of the four leading ids gets a weight, order 0 the rest. The weights are learnt per state (the
trusts and which of the four agree) from how often each speaker was right. An id is coded in one step of the range
coder: its interval is its order-0 interval, moved by the weights of leading ids below it and widened by its own.
All arithmetic is in integers, so machines agree.

Layout of a coded stream (little endian): b"CMRC", u8 version, u32 ids, u32 ids per block, then for each block u32 bytes
and u32 crc32 of its ids as u32, then the blocks. A block: u32 distinct ids and u32 bytes of their packed differences,
these, u16 words of each lane, the lanes' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .packed import pack, unpack

BLOCK, LANES, STEPS = 1 << 21, 8192, 128  # STEPS: the least length of a lane, where a block allows
MAGIC, VERSION = b"CMRC", 3
_HEAD, _BLOCK_HEAD = struct.Struct("<4sBII"), struct.Struct("<II")
_MASS, _FINE = 16, 22  # bits of a weight, and of an order-0 probability
_TOTAL = np.uint64(_MASS + _FINE)
_TOP, _LOW, _WORD = np.uint64(48), np.uint64((1 << 48) - 1), np.uint64(16)
_SMALL = np.uint64(1 << 46)  # a range this large takes a step
_TWO_SLOTS = 19  # bits of an order-2 slot
_ADD, _MOST = 32, 1 << 26  # what an id adds to its order-0 count, and the sum that halves all
_LEVEL = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, *[7] * 16])  # of the first id's trust; the second's has two
_STATES = 16 * 16 * 5
_TRUSTED = 31
#: a slot packs trust of the first id (5 bits), of the second (5), a check of its context (12), second and first id (21 each)
_BITS = 21
_ID, _CHECK = (1 << _BITS) - 1, (1 << 12) - 1


def _trust_table() -> np.ndarray:
    """By trust of the first and second id and what came (first, second, neither): new trusts << 2 | change of the ids.

    A hit gains trust; the second passes the first once it has more (1: they change places); another id costs the second
    trust, takes its place when it has none (3) and the first's where the context is new (2).
    """
    out = np.zeros((32, 32, 3), np.int64)
    for one in range(32):
        for two in range(32):
            for came in range(3):
                a, b, change = one, two, 0
                if came == 0:
                    a = min(a + 1, _TRUSTED)
                elif came == 1:
                    b = min(b + 2, _TRUSTED)
                    if b > a:
                        a, b, change = b, a, 1
                elif a == 0:
                    a, b, change = 1, 0, 2
                elif b == 0:
                    b, change = 1, 3
                else:
                    b -= 1
                out[one, two, came] = (((a << 5) | b) << 2) | change
    return out.ravel()


def _slot_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By trusts << 2 | is the first id | is the second id << 1: the new slot's trusts with a mask of the ids that stay
    in place, what the id that came and what the first id is multiplied by to stand in its new place (0: nowhere)."""
    trusts, hit = np.divmod(np.arange(4096), 4)
    came = np.where((hit & 1 == 1) & (trusts > 31), 0, np.where((hit == 2) & (trusts & 31 > 0), 1, 2))
    new = _trust_table()[trusts * 3 + came]
    change = new & 3
    stay = np.array([_ID << _BITS | _ID, 0, _ID << _BITS, _ID])[change]
    return (new >> 2) << 54 | stay, np.array([0, 1, 1, 1 << _BITS])[change], np.array([0, 1 << _BITS, 0, 0])[change]


_SLOT, _PLACE, _SECOND = _slot_tables()
_LEVELS = (_LEVEL[:, None] * 2 + (np.arange(32) > 1)).ravel()
_TRUSTS, _CHECKS = -1 << 54, _CHECK << 2 * _BITS
_HITS = np.arange(16)  # which of the four leading ids came, a bit each
_WHO = np.where(_HITS & 1, 0, np.where(_HITS & 2, 1, np.where(_HITS & 4, 2, np.where(_HITS & 8, 3, 4))))
#: by a == c, b == d, a == d and b == c, a bit each: which of the leading ids agree
_ALIKE = np.where(_HITS & 1, 1 + (_HITS >> 1 & 1), 0) + np.where(_HITS & 4, 3, 0) + np.where((_HITS & 8 > 0) & (_HITS & 4 == 0), 4, 0)
_STRETCH = 1 << 17
_NEAR = 8  # bits of order-0 places that share an entry of the table of nearest ids


def _bits(*flags: np.ndarray) -> np.ndarray:
    """Flags as the bits of a number, the first the lowest."""
    out = flags[0].view(np.uint8).copy()
    for k, flag in enumerate(flags[1:], 1):
        out |= flag.view(np.uint8) << k
    return out


class _Slots:
    """The two leading ids of every context of one order."""

    def __init__(self, n: int):
        self.packed = np.zeros(n, np.int64)

    def read(self, at: np.ndarray, check: np.ndarray | None = None) -> None:
        """`check`: in its place in the slot; None where each context has a slot of its own."""
        x = self.packed.take(at)
        if check is not None:
            x *= (x & _CHECKS) == check
        self.at, self.check, self.slot = at, check, x
        self.a = x & _ID
        self.trust = x >> 2 * _BITS + 12
        self.trust &= 1023
        x = x >> _BITS
        x &= _ID
        self.b = x
        self.level = _LEVELS.take(self.trust)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """`hit`: bit 0 where the first id came, bit 1 where the second."""
        event = self.trust << 2
        event += hit
        new = self.slot
        new |= _TRUSTS
        new &= _SLOT.take(event)
        new |= ids * _PLACE.take(event)
        new |= self.a * _SECOND.take(event)
        if self.check is not None:
            new |= self.check
        self.packed[self.at] = new


class _Model:
    """The shared model of a block with `n` distinct ids."""

    def __init__(self, n: int):
        self.n = n
        self.count = np.ones(n, np.int64)
        self.one, self.two = _Slots(n + 1), _Slots(1 << _TWO_SLOTS)
        self.right = np.tile(np.array([30, 8, 8, 4, 14], np.int64), (_STATES, 1))  # of the four leading ids and of order 0
        self.new: list[np.ndarray] = []
        self.steps = self.due = 0
        self._refresh()

    def _refresh(self) -> None:
        """Cumulative tables from the counts so far."""
        if self.new:
            self.count += _ADD * np.bincount(np.concatenate(self.new), minlength=self.n)
            self.new = []
        total = int(self.count.sum())
        if total > _MOST:
            self.count = (self.count + 1) >> 1
            total = int(self.count.sum())
        cum = np.concatenate([[0], np.cumsum(self.count)])
        self.cum = cum * ((1 << _FINE) - self.n) // total + np.arange(self.n + 1)
        self.size = np.diff(self.cum)
        # the id that holds the first place of every stretch of places
        self.near = np.cumsum(np.bincount((self.cum[:-1] + ((1 << _NEAR) - 1)) >> _NEAR, minlength=(1 << _FINE - _NEAR) + 1)) - 1
        every = self.right.sum(1)
        old = every > 1 << 14
        if old.any():
            self.right[old] = (self.right[old] + 1) >> 1
            every = self.right.sum(1)
        mass = self.right[:, :4] * ((1 << _MASS) - 64) // every[:, None]
        self.mass = [mass[:, k].astype(np.int32) for k in range(4)]
        self.rest = (1 << _MASS) - mass.sum(1)
        self.due = self.steps + max(1, min(8, self.steps // 16))

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """The leading ids and weights after `one`, before it `two` (places among the distinct ids, from 1; 0: none)."""
        if self.steps >= self.due:
            self._refresh()
        mixed = one * 0x9E3779B1
        mixed += two * 0x85EBCA77
        mixed &= 0xFFFFFFFFFF
        mixed ^= mixed >> 15
        mixed *= 0x2C1B3C6D
        check = mixed >> 6
        check &= _CHECK - 1
        check += 1
        check <<= 2 * _BITS
        mixed >>= 20
        mixed &= (1 << _TWO_SLOTS) - 1
        self.one.read(one)
        self.two.read(mixed, check)
        self.leading = a, b, c, d = [x.astype(np.int32) for x in (self.two.a, self.two.b, self.one.a, self.one.b)]
        self.state = self.two.level << 4
        self.state += self.one.level
        self.state *= 5
        self.state += _ALIKE.take(_bits(a == c, b == d, a == d, b == c))
        self.weight = [m.take(self.state) for m in self.mass]
        self.other = self.rest.take(self.state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's interval begins and how large it is, of 2**38."""
        short = ids.astype(np.int32)
        self.came = [x == short for x in self.leading]
        below, own = (sum(w * flag for w, flag in zip(self.weight, flags)).astype(np.int64) for flags in ((x < short for x in self.leading), self.came))
        out = []
        for moved, table in ((below, self.cum), (own, self.size)):
            moved <<= _FINE
            moved += self.other * table.take(ids)
            out.append(moved)
        return out[0], out[1]

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these places."""
        both = [(x.astype(np.int64) << _MASS) | w for x, w in zip(self.leading, self.weight)]
        for i, j in ((0, 1), (2, 3), (0, 2), (1, 3), (1, 2)):  # ascending
            both[i], both[j] = np.minimum(both[i], both[j]), np.maximum(both[i], both[j])
        rest = at.copy()
        for x in both:
            over = self.cum.take(x >> _MASS)
            over *= self.other
            np.subtract(rest, over, out=over)
            x &= (1 << _MASS) - 1
            x <<= _FINE
            np.minimum(np.maximum(over, 0, out=over), x, out=over)
            rest -= over
        place = rest.view(np.uint64) // self.other.view(np.uint64)
        return self._holding(place.view(np.int64))

    def _holding(self, place: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold these places: by the nearest ids, searched where these differ."""
        stretch = place >> _NEAR
        ids = self.near.take(stretch)
        stretch += 1
        open_ = np.flatnonzero(ids != self.near.take(stretch))
        ids[open_] = np.searchsorted(self.cum, place[open_], "right") - 1
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """After `interval` of the same ids."""
        hits = _bits(*self.came)
        self.state *= 5
        self.state += _WHO.take(hits)
        self.right += np.bincount(self.state, minlength=_STATES * 5).reshape(_STATES, 5)
        self.two.learn(ids, hits & 3)
        self.one.learn(ids, hits >> 2)
        self.new.append(ids)
        self.steps += 1


class _Lanes:
    """Range coders side by side."""

    def __init__(self, n: int):
        self.n, self.low, self.range = n, np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.used = np.zeros(n, np.int64)

    def take(self, low: np.ndarray, size: np.ndarray) -> None:
        step = self.range >> _TOTAL
        self.low += step * low.view(np.uint64)
        self.range = step * size.view(np.uint64)
        self.settle()

    def settle(self) -> None:
        """Shift out settled words, lowering ranges that straddle a boundary, until each range is wide."""
        who = np.flatnonzero(self.range < _SMALL)
        while len(who):
            low, rng = self.low[who], self.range[who]
            open_ = np.flatnonzero((low ^ (low + rng - np.uint64(1))) >> _TOP)
            rng[open_] = (np.uint64(0) - low[open_]) & _LOW
            rng <<= _WORD
            self.shift(who, low)
            low <<= _WORD
            self.low[who], self.range[who] = low, rng
            who = who[rng < _SMALL]


class _Writer(_Lanes):
    def __init__(self, n: int, most: int):
        super().__init__(n)
        self.out = np.zeros((n, most + 8), np.uint16)

    def shift(self, who: np.ndarray, low: np.ndarray) -> None:
        if int(self.used.max()) + 2 > self.out.shape[1]:
            self.out = np.hstack([self.out, np.zeros_like(self.out)])
        used = self.used[who]
        self.out.ravel()[who * self.out.shape[1] + used] = low >> _TOP
        used += 1
        self.used[who] = used

    def flush(self) -> bytes:
        # the shortest number within the range: one word where it is wide enough, else more
        every = np.arange(self.n)
        top = (self.low + _LOW) & ~_LOW
        short = (top >= self.low) & (top - self.low < self.range)
        self.low = np.where(short, top, self.low)
        self.shift(every, self.low)
        self.low = self.low << _WORD
        for _ in range(3):
            who = every[~short]
            if len(who):
                self.shift(who, self.low[who])
                self.low[who] = self.low[who] << _WORD
        return self.used.astype("<u2").tobytes() + b"".join(self.out[i, : self.used[i]].astype("<u2").tobytes() for i in range(self.n))


class _Reader(_Lanes):
    def __init__(self, n: int, raw: bytes):
        super().__init__(n)
        sizes = np.frombuffer(raw, "<u2", n).astype(np.int64)
        # a lane is read at most three words beyond its end: these are 0
        words, gaps = np.frombuffer(raw, "<u2", int(sizes.sum()), 2 * n), 4 * np.arange(n)
        self.words = np.zeros(len(words) + 4 * n, np.uint64)
        self.words[np.arange(len(words)) + np.repeat(gaps, sizes)] = words
        self.used = np.cumsum(sizes) - sizes + gaps
        self.code = np.zeros(n, np.uint64)
        every = np.arange(n)
        for _ in range(4):
            self.shift(every, self.low)

    def shift(self, who: np.ndarray, low: np.ndarray) -> None:
        at, code = self.used[who], self.code[who]
        code <<= _WORD
        code |= self.words[at]
        at += 1
        self.code[who], self.used[who] = code, at

    def place(self) -> np.ndarray:
        return np.minimum((self.code - self.low) // (self.range >> _TOTAL), np.uint64((1 << (_MASS + _FINE)) - 1)).view(np.int64)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // STEPS))


def _stretches(n: int) -> list[slice]:
    """What numpy makes of a stretch at a time (64-bit copies of indices among it) is small beside a block."""
    return [slice(i, min(i + _STRETCH, n)) for i in range(0, n, _STRETCH)]


def _named(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the place of each id among them."""
    if int(ids.max()) > _ID:
        names, places = np.unique(ids, return_inverse=True)
        return names, places.astype(np.int32)
    seen = np.zeros(int(ids.max()) + 1, bool)
    for s in _stretches(len(ids)):
        seen[ids[s]] = True
    names = np.flatnonzero(seen)
    where = np.zeros(len(seen), np.int32)
    where[names] = np.arange(len(names))
    places = np.empty(len(ids), np.int32)
    for s in _stretches(len(ids)):
        places[s] = where[ids[s]]
    return names, places


def encode_block(ids: np.ndarray) -> bytes:
    """The coded bytes of one block, at least one id."""
    names, places = _named(ids)
    lanes = _lanes(len(ids))
    steps = -(-len(ids) // lanes)
    if len(ids) < lanes * steps:
        places = np.append(places, np.full(lanes * steps - len(ids), places[-1], np.int32))  # the last id fills up
    places = places.reshape(lanes, steps)
    model, coder = _Model(len(names)), _Writer(lanes, steps)
    one = two = np.zeros(lanes, np.int64)
    for t in range(0, steps, 16):
        for now in np.ascontiguousarray(places[:, t : t + 16].T, np.int64):
            model.predict(one, two)
            coder.take(*model.interval(now))
            model.learn(now)
            one, two = now + 1, one
    packed = pack(np.diff(names.astype(np.int64), prepend=0))
    return _BLOCK_HEAD.pack(len(names), len(packed)) + packed + coder.flush()


def decode_block(raw: bytes, n: int) -> np.ndarray:
    """The `n` ids of a block."""
    kinds, size = _BLOCK_HEAD.unpack_from(raw)
    names = np.cumsum(unpack(raw[_BLOCK_HEAD.size : _BLOCK_HEAD.size + size])[0].astype(np.int64))
    lanes = _lanes(n)
    model, coder = _Model(kinds), _Reader(lanes, raw[_BLOCK_HEAD.size + size :])
    out = np.zeros((-(-n // lanes), lanes), np.int32)
    one = two = np.zeros(lanes, np.int64)
    for t in range(len(out)):
        model.predict(one, two)
        now = model.find(coder.place())
        coder.take(*model.interval(now))
        model.learn(now)
        out[t] = now
        one, two = now + 1, one
    names, ids, steps = names.astype(np.uint32), np.empty(n, np.uint32), len(out)
    each = max(1, _STRETCH // steps)
    for a in range(0, lanes, each):
        own = names[out[:, a : a + each].T.ravel()]
        ids[a * steps : (a + each) * steps] = own[: max(n - a * steps, 0)]
    return ids


def ids_crc(ids: np.ndarray) -> int:
    """The crc32 of ids as little-endian 32-bit integers."""
    crc = 0
    for s in _stretches(len(ids)):
        crc = zlib.crc32(ids[s].astype("<u4").tobytes(), crc)
    return crc


def _stream(ids: np.ndarray) -> bytes:
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    raw = [encode_block(b) for b in blocks]
    table = b"".join(struct.pack("<II", len(r), ids_crc(b)) for r, b in zip(raw, blocks))
    return _HEAD.pack(MAGIC, VERSION, len(ids), BLOCK) + table + b"".join(raw)


def encode(streams: list[np.ndarray]) -> list[bytes]:
    """Each array of ids (below 2**32) as a coded stream."""
    return [_stream(ids) for ids in streams]


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded stream; a block whose checksum differs raises ValueError."""
    return [_ids(raw) for raw in payloads]


def _ids(raw: bytes) -> np.ndarray:
    magic, version, n, size = _HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a coded id stream")
    blocks = -(-n // size)
    table = np.frombuffer(raw, "<u4", 2 * blocks, _HEAD.size).reshape(-1, 2).tolist()
    at, out = _HEAD.size + 8 * blocks, []
    for i, (length, crc) in enumerate(table):
        try:
            ids = decode_block(raw[at : at + length], min(size, n - i * size))
        except (ValueError, IndexError, struct.error, OSError) as e:
            raise ValueError("a block's checksum differs: it cannot be read") from e
        if ids_crc(ids) != crc:
            raise ValueError("a block's checksum differs")
        out.append(ids)
        at += length
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint32), *out])
