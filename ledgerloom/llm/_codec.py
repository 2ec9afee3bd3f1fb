"""A context-mixing range coder for token ids, run over many blocks side by side.

Every block starts from a fresh model and a fresh coder, so blocks can be read alone; they are stepped through
together, one id of each at a time, so that numpy does the work. Three orders predict the next id:

* order 2: the id that followed the last two ids before, with a trust (how often in a row it did);
* order 1: the id that followed the last id before, with its trust;
* order 0: every id of the block so far, as often as it came; an id never met is written out.

Their predictions are mixed: each order has a share of the number line, set by how often it was right before in
the same state (both trusts, and whether orders 2 and 1 agree), and each id has the share of the orders that
predict it (orders that agree lie side by side and count together). Shares and order 0's frequencies are learned
from the block so far, ever more seldom. All arithmetic is in integers (quotients of small numbers are taken in
doubles, where they are exact), so any machine decodes what another one wrote.

A frame: magic, version, bytes of an id, number of blocks; then for each block its ids, words and the CRC-32 of
its ids (little-endian unsigned 32-bit); the CRC-32 of all that; then the words of all blocks one after another,
30 bits each. The last of several blocks is filled up with zeros, which the reader drops.
"""

from __future__ import annotations

import struct
import zlib
from itertools import pairwise

import numpy as np

BLOCK = 2048
MAGIC, VERSION = b"LLTI", 4
_WORD, _LEAST_BITS = 30, 30
_LEAST, _WHOLE = 1 << _LEAST_BITS, 1 << _LEAST_BITS + _WORD
#: The number line is cut into 2**_UNITS units, and each of them so finely that an id of 16 bits fits into one.
_UNITS, _FINE = 10, 16
_LINE = _UNITS + _FINE
_SLOT_BITS, _CHECK_BITS = 10, 14
_CHECK = (1 << _CHECK_BITS) - 1
_ORDER2, _ORDER1, _ORDER0, _NEW = range(4)
#: Units that orders 0 and new ids, and an order with a prediction, have at least.
_FLOOR = 4
#: Lanes whose past is sorted together: few enough to stay in the processor's cache.
_GROUP = 64


class _Coder:
    """Range coder with 30-bit words, one state a lane. The range is at least 2**30 before a step and at least
    2**6 after it, so a step moves one word at most; carries stay above the words until ``finish`` hands them on.
    """

    def __init__(self, lanes: int, size: int, words: np.ndarray | None = None):
        self.decodes = words is not None
        self.words = words if self.decodes else np.zeros((size, lanes), np.uint32)
        self.flat, self.lanes = self.words.reshape(-1), lanes
        self.at = np.arange(lanes)
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _WHOLE)
        if self.decodes:  # here ``low`` is the distance from the low end to the code
            for _ in range(2):
                self.low = self.low << _WORD | self.flat[self.at]
                self.at += lanes

    def value(self, bits: int) -> np.ndarray:
        return np.minimum(self.low // (self.range >> bits), (1 << bits) - 1)  # the bound is for damaged words

    def step(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        r = self.range >> bits
        self.range = r * size
        r *= start
        need = (self.range < _LEAST).astype(np.int64)
        shift = need * _WORD
        if self.decodes:
            self.low -= r
            self.low <<= shift
            self.low += self.flat.take(self.at, mode="clip") * need
        else:
            self.low += r
            self.flat[self.at] = self.low >> _LEAST_BITS
            self.low &= (need << _LEAST_BITS) - need | need - 1
            self.low <<= shift
        self.range <<= shift
        need *= self.lanes
        self.at += need

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes, a lane a row, and how many are in use."""
        for _ in range(2):
            self.flat[self.at] = self.low >> _LEAST_BITS
            self.low = (self.low & _LEAST - 1) << _WORD
            self.at += self.lanes
        used = self.at // max(self.lanes, 1)
        words = self.words[: used.max(initial=0)]
        words[np.arange(len(words))[:, None] >= used] = 0
        while (carry := words >> _WORD).any():
            words &= (1 << _WORD) - 1
            words[:-1] += carry[1:]
        return np.ascontiguousarray(words.T), used


class _Memory:
    """For orders 1 and 2 (two rows): the id that followed a context last and its trust, as id, check bits of
    the context and trust in one number. The check bits tell contexts apart that share a slot."""

    def __init__(self, lanes: int, width: int):
        self.first = np.arange(2 * lanes).reshape(2, lanes) << _SLOT_BITS
        self.records = np.zeros(2 * lanes << _SLOT_BITS, np.uint32 if width < 4 else np.uint64)
        self.kind = self.records.dtype.type

    def look(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids predicted for both contexts (uint32), and how far to trust them (0: not at all)."""
        mixed = context * np.uint32(0x9E3779B1)
        self.at = self.first + (mixed >> np.uint32(32 - _SLOT_BITS))
        self.check = (mixed & np.uint32(_CHECK)).astype(self.kind, copy=False)
        record = self.records.take(self.at)
        trust = (record & self.kind(3)) * ((record >> self.kind(2) & self.kind(_CHECK)) == self.check)
        return (record >> self.kind(_CHECK_BITS + 2)).astype(np.uint32, copy=False), trust.astype(np.int32, copy=False)

    def learn(self, right: np.ndarray, trust: np.ndarray, ids: np.ndarray) -> None:
        """``right``: whether each prediction came true."""
        trust = np.minimum(trust * right + np.int32(1), np.int32(3))
        self.records[self.at] = (ids.astype(self.kind, copy=False) << self.kind(_CHECK_BITS) | self.check) << self.kind(2) | trust.astype(self.kind)


class _Shares:
    """Where the shares of order 1, order 0 and new ids begin for every state, learned from what came true."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        state = np.arange(32)
        trust2, trust1, agree = state >> 3, state >> 1 & 3, state & 1
        self.has2, self.has1 = trust2 > 0, (trust1 > 0) & ~((agree == 1) & (trust2 > 0))
        prior = np.stack([self.has2 * (1 + 2 * trust2), self.has1 * (1 + trust1), np.full(32, 4), np.full(32, 4)], 1)
        self.counts = np.broadcast_to(prior.astype(np.int32), (lanes, 32, 4)).copy()
        self._fill()

    def learn(self, states: np.ndarray, came: np.ndarray) -> None:
        """Steps x lanes each."""
        at = (np.arange(0, self.lanes * 128, 128, dtype=np.int32) + (states.astype(np.int32) << 2 | came)).reshape(-1)
        self.counts += 2 * np.bincount(at, minlength=128 * self.lanes).reshape(self.counts.shape).astype(np.int32)
        self._fill()

    def _fill(self) -> None:
        floor = _FLOOR * np.stack([self.has2, self.has1, np.ones(32, bool), np.ones(32, bool)], 1).astype(np.int32)
        free = (1 << _UNITS) - floor.sum(1, dtype=np.int32)
        sums = np.cumsum(self.counts, axis=2, dtype=np.int32)
        ends = sums[:, :, :3] * free[:, None] // sums[:, :, 3:] + np.cumsum(floor, axis=1, dtype=np.int32)[:, :3]
        self.table = (ends[:, :, 0] | ends[:, :, 1] << _UNITS | ends[:, :, 2] << 2 * _UNITS).reshape(-1)


def _renewals(steps: int) -> list[int]:
    """After how many ids the model is learned anew: ever more seldom."""
    out, due = [0], 16
    while due < steps:
        out.append(due)
        due += max(16, due // 2)
    return [*out, steps]


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a sorted matrix, where the runs of equal values start and how long they are, in one sequence."""
    new = np.ones(value.shape, bool)
    np.not_equal(value[:, 1:], value[:, :-1], out=new[:, 1:])
    at = np.flatnonzero(new)
    return at, np.diff(at, append=value.size)


class _Past:
    """Order 0: the ids of a block so far in ascending order; an id's share is the stretch it fills."""

    def __init__(self, ids: np.ndarray):
        """For decoding: every place of the stretches tells the id (``ids``: lanes x those past), their first place
        and their number."""
        lanes, self.n = ids.shape
        self.table, self.base = np.empty(ids.size, np.int64), np.arange(lanes) * self.n
        for a in range(0, lanes, _GROUP):
            value = np.sort(ids[a : a + _GROUP], axis=1)
            at, length = _runs(value)
            packed = value.reshape(-1)[at].astype(np.int64) << 32 | (at % self.n) << 16 | length
            self.table[a * self.n : a * self.n + value.size] = np.repeat(packed, length)

    @staticmethod
    def ahead(ids: np.ndarray, known: int) -> np.ndarray:
        """For encoding: first place << 16 | number, of each id (steps x lanes) after the first ``known`` ones; 0 if new."""
        lanes, n = ids.shape
        out = np.empty((n - known, lanes), np.int32)
        for a in range(0, lanes, _GROUP):
            out[:, a : a + _GROUP] = _Past._ahead(ids[a : a + _GROUP], known).T
        return out

    @staticmethod
    def _ahead(ids: np.ndarray, known: int) -> np.ndarray:
        lanes, n = ids.shape
        kind = np.uint32 if ids.max(initial=0) < 65536 else np.uint64
        packed = ids.astype(kind)
        packed <<= kind(16)
        packed |= np.arange(n, dtype=kind)
        packed.sort(axis=1)
        place = packed & kind(0xFFFF)
        at, length = _runs(packed >> kind(16))
        before = np.zeros(place.size + 1, np.int32)
        np.cumsum(place.reshape(-1) < known, dtype=np.int32, out=before[1:])
        first = before[at]
        count = before[at + length] - first  # the past comes first in a run
        first %= np.int32(max(known, 1))
        found = np.where(count > 0, first << 16 | count, np.int32(0))
        spot = place.astype(np.int64)
        spot += np.arange(0, lanes * n, n)[:, None]
        out = np.empty((lanes, n), np.int32)
        out.reshape(-1)[spot.reshape(-1)] = np.repeat(found, length)
        return out[:, known:]


def _run(coder: _Coder, width: int, ids: np.ndarray) -> None:
    """Step through all blocks, the rows of ``ids`` (lanes x steps); while decoding, fill it in."""
    lanes, steps = ids.shape
    if not ids.size:
        return
    memory, shares, decodes = _Memory(lanes, width), _Shares(lanes), coder.decodes
    own = np.arange(lanes) * 32
    context = np.zeros((2, lanes), np.uint32)
    states, came = np.zeros((steps, lanes), np.uint8), np.zeros((steps, lanes), np.uint8)
    one, part, whole, learned = np.int32(1), np.int32((1 << _UNITS) - 1), np.int32(1 << _UNITS), 0
    for a, b in pairwise(_renewals(steps)):
        if a:
            shares.learn(states[learned:a], came[learned:a])
            learned = a
        if decodes:
            rows = np.zeros((b - a, lanes), np.uint32)
            past = _Past(ids[:, :a]) if a else None
        else:
            rows, ahead = np.ascontiguousarray(ids[:, a:b].T), _Past.ahead(ids[:, :b], a)
        for t in range(b - a):
            guess, trust = memory.look(context)
            state = trust[1] << 3 | trust[0] << 1 | (guess[0] == guess[1])
            table = shares.table.take(own + state)
            end2, end1, end0 = table & part, table >> _UNITS & part, table >> 2 * _UNITS
            each = (end0 - end1 << _FINE) // np.int32(max(a, 1))  # of the line, for each id of the past
            if decodes:
                value = coder.value(_LINE).astype(np.int32)
                unit = value >> _FINE
                hit2, hit, new = unit < end2, unit < end1, unit >= end0
            else:
                x = rows[t]
                entry = ahead[t]
                right = guess == x
                known = right & (trust > 0)
                hit2, hit, new = known[1], known[0] | known[1], entry == 0
            # the stretch of the line: a new id has its part of each of its units, order 0 so many parts of its share,
            # and orders 2 and 1 have whole units
            begin, share = np.where(new, end0, end1) << _FINE, np.where(new, whole - end0, each)
            if decodes:
                spot = ((value - begin) / share).astype(np.int64)
                if a:
                    entry = past.table.take(past.base + np.clip(spot, 0, a - 1))
                    first, count, seen = (entry >> 16 & 65535).astype(np.int32), (entry & 65535).astype(np.int32), (entry >> 32).astype(np.uint32)
                    x = np.where(new, spot.astype(np.uint32), seen)
                else:
                    first = count = one
                    x = spot.astype(np.uint32)
                x = np.where(hit, np.where(hit2, guess[1], guess[0]), x)
                right = guess == x
                place = np.where(new, spot.astype(np.int32), first)
            else:
                count = entry & 65535
                place = np.where(new, (x & np.uint32(65535)).astype(np.int32), entry >> 16)
            begin += place * share
            share *= np.where(new, one, count)
            begin = np.where(hit, np.where(hit2, 0, end2 << _FINE), begin)
            share = np.where(hit, np.where(hit2, end2, end1 - end2) << _FINE, share)
            coder.step(begin, share, _LINE)
            if width == 4:  # the upper half of a new id
                new &= ~hit
                if decodes:
                    high = np.where(new, coder.value(16), 0)
                    x = np.where(new, x | high.astype(np.uint32) << np.uint32(16), x)
                    right = guess == x
                else:
                    high = np.where(new, x >> np.uint32(16), 0)
                coder.step(high.astype(np.int64), np.where(new, 1, 1 << 16), 16)
            memory.learn(right, trust, x)
            context[1] = context[0] * np.uint32(65599) + x
            context[0] = x
            states[a + t] = state
            came[a + t] = (new.view(np.uint8) + np.uint8(_ORDER0)) * ~hit | (hit > hit2)  # _ORDER2, _ORDER1 where hit, else _ORDER0, _NEW
            if decodes:
                rows[t] = x
        if decodes:
            ids[:, a:b] = rows.T


def encode_frame(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame of all ids (unsigned 32-bit), cut into blocks of ``block`` (at most 32,768)."""
    ids = np.ascontiguousarray(ids, "<u4")
    width = 4 if len(ids) and ids.max() >> 16 else 2
    count, steps = -(-len(ids) // block), min(block, len(ids))
    grid = np.zeros((count, steps), np.uint32)
    grid.reshape(-1)[: len(ids)] = ids
    coder = _Coder(count, (_LINE + 3 + 20 * (width // 4)) * steps // _WORD + 8)
    _run(coder, width, grid)
    words, used = coder.finish()
    head = [struct.pack("<4sBBI", MAGIC, VERSION, width, count)]
    for k in range(count):
        own = ids[k * block : (k + 1) * block]
        head.append(struct.pack("<III", len(own), int(used[k]), zlib.crc32(own.tobytes())))
    head.append(struct.pack("<I", zlib.crc32(b"".join(head))))
    all_words = words[np.arange(words.shape[1]) < used[:, None]] if count else np.empty(0, np.uint32)
    bits = np.unpackbits(all_words.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - _WORD :]
    return b"".join([*head, np.packbits(bits).tobytes()])


def decode_frame(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises ValueError where a checksum or the head does not fit."""
    magic, version, width, count = struct.unpack_from("<4sBBI", frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of token ids")
    at = 14 + 12 * count
    if len(frame) < at or zlib.crc32(frame[: at - 4]) != struct.unpack_from("<I", frame, at - 4)[0]:
        raise ValueError("the head of a frame of token ids is damaged")
    head = np.frombuffer(frame, "<u4", 3 * count, 10).reshape(-1, 3).astype(np.int64)
    sizes, used = head[:, 0], head[:, 1]
    total = int(used.sum())
    if len(frame) != at + -(-total * _WORD // 8):
        raise ValueError("a frame of token ids is cut short")
    bits = np.unpackbits(np.frombuffer(frame, np.uint8, offset=at), count=total * _WORD).reshape(-1, _WORD)
    padded = np.zeros((total, 32), np.uint8)
    padded[:, 32 - _WORD :] = bits
    words = np.zeros((count, int(used.max(initial=0)) + 2), np.uint32)
    words[np.arange(words.shape[1]) < used[:, None]] = np.packbits(padded).view(">u4")
    del bits, padded
    grid = np.zeros((count, int(sizes.max(initial=0))), np.uint32)
    _run(_Coder(count, 0, np.ascontiguousarray(words.T)), width, grid)
    grid = grid.astype("<u4", copy=False)
    out = [grid[k, :n] for k, n in enumerate(sizes.tolist())]
    for ids, crc in zip(out, head[:, 2].tolist()):
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    return np.concatenate(out) if out else np.empty(0, "<u4")
