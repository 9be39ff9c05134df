"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes of about 256 ids that are coded side by side: step t codes the
t-th id of every lane. All lanes share one model, which is updated after each step, so the model
learns from thousands of ids a step and every operation is one of whole arrays. Arithmetic is in
integers, so encoder and decoder stay equal on any machine.

The chance of an id mixes three predictions:

* order 0: how often each id was seen in the block (every id counts once at least),
* order 1: the id that followed the last one, as a slot of a table remembers it,
* order 2: the same for the last two.

The weights of the three are learned for each pair of confidences of the two tables: what each
prediction contributed to the chance of the ids that came is added up. The mixed chances of an id
form one interval, which a carryless range coder with 64 bits of state narrows to; it puts out
words of 16 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"QMTK", 1
#: magic, version, vocabulary, ids, lanes, words of payload, crc32 of the ids, crc32 of all that stands before it and of the payload
_HEADER = struct.Struct("<4sBIIIIII")
_U = np.uint64
_ORDER0, _TOTAL = 20, 22  # bits of the sums of order-0 and of mixed chances
_LEAST = 1 << _ORDER0  # of _TOTAL, what order 0 keeps: every id has a chance
_TOP, _SAME, _LOW = _U(48), _U(1 << 48), _U((1 << 32) - 1)


class Model:
    """What both sides know before each step."""

    def __init__(self, vocabulary: int, decoding: bool):
        if not 0 < vocabulary <= 1 << (_ORDER0 - 1):
            raise ValueError(f"a vocabulary of 1 to {1 << (_ORDER0 - 1)} ids is coded, not {vocabulary}")
        self.vocabulary, self.decoding = vocabulary, decoding
        self.counts, self.steps = np.zeros(vocabulary, np.int64), 0
        self.recent: list[np.ndarray] = []  # ids of the steps since the last count
        self.slots = [np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)]  # id * 4 + confidence, of order 1 and 2
        self.shares = np.array([[0 if k == 0 else 64 * k for k in range(4)] * 4, [k // 4 * 64 for k in range(16)], [256] * 16], np.int64) * 256
        self._count()

    def _count(self) -> None:
        """Order-0 chances anew from the counts."""
        free = (1 << _ORDER0) - self.vocabulary
        own = 1 + self.counts * free // max(int(self.counts.sum()), 1)
        own[int(self.counts.argmax())] += (1 << _ORDER0) - int(own.sum())
        self.below = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(own, out=self.below[1:])
        if self.decoding:
            self.at = np.repeat(np.arange(self.vocabulary, dtype=np.uint16 if self.vocabulary <= 1 << 16 else np.int32), own)

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        """Predictions and weights for lanes whose last two ids are `last` and `before`."""
        self.places = (last * 40503 + (last >> 9)) & 0xFFFF, (last * 0x9E3779B1 + before * 0x85EBCA6B >> 13) & 0x3FFFF
        self.held = self.slots[0][self.places[0]], self.slots[1][self.places[1]]
        self.guess = tuple((held >> 2).astype(np.int64) for held in self.held)  # indices are taken faster as they are than narrower
        self.kind = ((self.held[1] & 3) << 2 | self.held[0] & 3).astype(np.int64)
        mass = ((1 << _TOTAL) - _LEAST) * self.shares[:2] // self.shares.sum(axis=0)
        self.weights = mass[0][self.kind], mass[1][self.kind]
        self.rest = ((1 << _TOTAL) - mass[0] - mass[1])[self.kind]

    def interval(self, ids: np.ndarray, added: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' intervals, of 1 << _TOTAL. `added`: the weights of guesses below the ids, if they are known."""
        start = self.rest * self.below[ids] >> _ORDER0
        size = (self.rest * self.below[ids + 1] >> _ORDER0) - start
        self.hits = tuple(np.flatnonzero(guess == ids) for guess in self.guess)
        for guess, weight, hit in zip(self.guess, self.weights, self.hits, strict=True):
            if added is None:
                start += weight * (guess < ids)
            size[hit] += weight[hit]
        return (start if added is None else start + added), size

    def find(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in whose intervals the targets lie, and the weights of guesses below them.

        An id is not above a guess whose end is not passed. If it is that guess, what order 0 says
        is the guess or above it, as the guess's weight is still in it; else order 0 is right.
        """
        left, most = target, []
        for k in (0, 1):
            guess, other, weight, more = self.guess[k], self.guess[1 - k], self.weights[k], self.weights[1 - k]
            end = (self.rest * self.below[guess + 1] >> _ORDER0) + weight
            end += more * (other <= guess)
            past = target >= end
            left = left - weight * past
            most.append(guess + past * self.vocabulary)
        # The quotients are below 1 << 22 and their divisors too, so those of doubles are off by less than a quotient can miss an integer by.
        place = np.minimum((((left + 1 << _ORDER0) - 1) / self.rest).astype(np.int64), (1 << _ORDER0) - 1)
        return np.minimum(np.minimum(self.at[place], most[0]), most[1]), target - left

    def learn(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Take in the ids of a step and the sizes of their intervals.

        A slot's confidence grows up to 3 when its id comes; another id takes its place if the
        confidence is 0 or 1, else lowers it.
        """
        came = np.bincount(self.kind, minlength=16) * 256
        new = (ids << 2 | 1).astype(np.int32)
        for k, (slots, place, held, weight, hit) in enumerate(zip(self.slots, self.places, self.held, self.weights, self.hits, strict=True)):
            part = np.bincount(self.kind[hit], np.floor((weight[hit] << 8) / size[hit]), 16).astype(np.int64)
            self.shares[k] += part
            came -= part
            after = new + (held - 1 - new) * (held >> 1 & 1)
            same = held[hit]
            after[hit] = same + ((same & 3) < 3)
            slots[place] = after
        self.shares[2] += came
        if self.shares.max() > 1 << 32:
            self.shares -= self.shares >> 1
        self.recent.append(ids)
        self.steps += 1
        if self.steps in (1, 2, 4, 8) or self.steps % 16 == 0:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary)
            self.recent = []
            self._count()


def _lanes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First id and length of each lane; longer lanes come first and differ by one id at most."""
    lanes = max(1, min(n // 256, 4096))
    length = np.full(lanes, n // lanes, np.int64)
    length[: n % lanes] += 1
    return np.cumsum(length) - length, length


def _turned(ids: np.ndarray, table: np.ndarray, length: np.ndarray, back: bool = False) -> np.ndarray:
    """Copies ids lane by lane into a table of steps and lanes, or back; 16 steps at a time, as whole cache lines of each lane are used then."""
    steps, long = len(table), int((length == len(table)).sum())
    longer, shorter = ids[: long * steps].reshape(long, steps), ids[long * steps :].reshape(len(length) - long, max(steps - 1, 0))
    for t in range(0, steps, 16):
        for lanes, own in ((table[t : t + 16, :long], longer[:, t : t + 16]), (table[t : min(t + 16, steps - 1), long:], shorter[:, t : t + 16])):
            if back:
                own[:] = lanes.T
            else:
                lanes[:] = own.T
    return ids if back else table


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids (each below `vocabulary`)."""
    ids = np.ascontiguousarray(ids, np.int64)
    first, length = _lanes(len(ids))
    steps, model = int(length[0]), Model(vocabulary, False)
    table = _turned(ids, np.zeros((steps, len(first)), np.int64), length)
    low, span = np.zeros(len(first), np.uint64), np.full(len(first), (1 << 64) - 1, np.uint64)
    out, spot = np.zeros((2 * steps + 8, len(first)), np.uint16), np.arange(len(first))  # word, lane: lanes fill alike
    flat = out.reshape(-1)  # a lane's next word has its place at `spot`
    last = before = np.zeros(len(first), np.int64)
    for t in range(steps):
        n = len(first) if t + 1 < steps else int((length == steps).sum())
        own, last, before, spot_t = table[t, :n], last[:n], before[:n], spot[:n]
        model.look(last, before)
        start, size = model.interval(own)
        unit = span[:n] >> _U(_TOTAL)
        low_t, span_t = low[:n] + unit * start.view(np.uint64), unit * size.view(np.uint64)
        lane, now, wide = None, low_t, span_t
        while True:
            same = (now ^ (now + wide)) < _SAME
            go = np.flatnonzero(same | (wide <= _LOW))
            if not len(go):
                break
            lane, same, now, wide = go if lane is None else lane[go], same[go], now[go], wide[go]
            place = spot_t[lane]
            flat[place] = now >> _TOP
            spot_t[lane] = place + len(first)
            wide, now = (wide if same.all() else np.where(same, wide, -now & _LOW)) << _U(16), now << _U(16)
            span_t[lane], low_t[lane] = wide, now
        low[:n], span[:n] = low_t, span_t
        model.learn(own, size)
        last, before = own, last
    end = low + _LOW  # rounded up to a multiple of 1 << 32, it lies in the interval
    for shift in (_U(48), _U(32)):
        flat[spot] = end >> shift & _U(0xFFFF)
        spot += len(first)
    filled = spot // len(first)
    payload = filled.astype("<u4").tobytes() + out.T[np.arange(len(out)) < filled[:, None]].astype("<u2").tobytes()
    head = _HEADER.pack(MAGIC, VERSION, vocabulary, len(ids), len(first), int(filled.sum()), zlib.crc32(ids.astype("<u4").tobytes()), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(payload, zlib.crc32(head))) + payload


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; an error if it is damaged."""
    if len(block) < _HEADER.size:
        raise ValueError("block is cut short")
    magic, version, vocabulary, n_ids, lanes, words, ids_crc, payload_crc = _HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    payload = memoryview(block)[_HEADER.size :]
    if len(payload) != 4 * lanes + 2 * words or zlib.crc32(payload, zlib.crc32(block[: _HEADER.size - 4])) != payload_crc:
        raise ValueError("block is damaged: its checksum differs")
    first, length = _lanes(n_ids)
    filled = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    steps, model = int(length[0]), Model(vocabulary, True)
    if int(filled.sum()) != words or int(filled.max()) > 2 * steps + 8:
        raise ValueError("block is damaged: its lanes' words differ from its words")
    code_words = np.zeros((int(filled.max()) + 1, lanes), np.uint16)  # word, lane; zeros after a lane's words
    code_words.T[np.arange(len(code_words)) < filled[:, None]] = np.frombuffer(payload, "<u2", words, 4 * lanes)
    flat, spot, none = code_words.reshape(-1), np.arange(lanes), code_words.size - 1

    def take(lane: np.ndarray) -> np.ndarray:
        place = spot[lane]
        spot[lane] = place + lanes
        return flat[np.minimum(place, none)].astype(np.uint64)

    lane = np.arange(lanes)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U(16) | take(lane)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    table = np.zeros((steps, lanes), np.uint32)
    last = before = np.zeros(lanes, np.int64)
    for t in range(steps):
        n = lanes if t + 1 < steps else int((length == steps).sum())
        last, before, code_t = last[:n], before[:n], code[:n]
        model.look(last, before)
        unit = span[:n] >> _U(_TOTAL)
        own, added = model.find(np.minimum((code_t - low[:n]) // unit, _U((1 << _TOTAL) - 1)).view(np.int64))
        table[t, :n] = own
        start, size = model.interval(own, added)
        low_t, span_t = low[:n] + unit * start.view(np.uint64), unit * size.view(np.uint64)
        lane, now, wide = None, low_t, span_t
        while True:
            same = (now ^ (now + wide)) < _SAME
            go = np.flatnonzero(same | (wide <= _LOW))
            if not len(go):
                break
            lane, same, now, wide = go if lane is None else lane[go], same[go], now[go], wide[go]
            code_t[lane] = code_t[lane] << _U(16) | take(lane)
            wide, now = (wide if same.all() else np.where(same, wide, -now & _LOW)) << _U(16), now << _U(16)
            span_t[lane], low_t[lane] = wide, now
        low[:n], span[:n] = low_t, span_t
        model.learn(own, size)
        last, before = own, last
    out = _turned(np.zeros(n_ids, np.uint32), table, length, back=True)
    if zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block is damaged: its ids' checksum differs")
    return out
