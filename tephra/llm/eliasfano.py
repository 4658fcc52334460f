"""Elias-Fano sequences over mapped arrays, queried many places at a time.

A monotone sequence keeps the low bits of each value in a packed array, and the high bits in unary. A running count of
ones in each word, and samples of where every 16th one and zero stands, answer access and successor search in a few
steps, without decoding.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SHIFT = 4
SAMPLE = 1 << SHIFT
_EACH, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)
_PAIRS, _FOURS, _EIGHTS = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)
#: Place of the r-th one of byte b, at r * 256 + b.
_SELECT = np.array([([j for j in range(8) if b >> j & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word that has more than k ones: the byte by sums of all bytes at once, the bit by a table."""
    k = k.astype(np.uint64)
    sums = words - (words >> _U(1) & _PAIRS)
    sums = (sums & _FOURS) + (sums >> _U(2) & _FOURS)
    sums = ((sums + (sums >> _U(4))) & _EIGHTS) * _EACH  # byte i: ones of the bytes up to i
    place = np.bitwise_count(((k * _EACH | _TOP) - sums) & _TOP).astype(np.uint64) << _U(3)
    rank = k - (sums << _U(8) >> place & _U(255))
    return place.astype(np.int64) + _SELECT[(rank << _U(8) | words >> place & _U(255)).astype(np.int64)]


def encode(values: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned values, their names beginning with ``name``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> _U(low)).astype(np.int64)
    ones = high + np.arange(n)
    size = n + (int(high[-1]) if n else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[ones] = 1
    zeros = np.flatnonzero(bits[:size] == 0)
    words = np.packbits(bits, bitorder="little").view("<u8")
    count = np.zeros(len(words) + 1, np.uint32)
    np.cumsum(bits.reshape(-1, 64).sum(1), out=count[1:])
    if low:
        packed = np.zeros((n * low + 63) // 64 + 1, np.uint64)
        part, at = values & _U((1 << low) - 1), np.arange(n) * low
        word = at >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if n:
            packed[word[first]] = np.bitwise_or.reduceat(part << (at & 63).astype(np.uint64), first)
        over = np.flatnonzero((at & 63) + low > 64)  # at most one a word
        packed[word[over] + 1] |= part[over] >> (64 - (at[over] & 63)).astype(np.uint64)
    else:
        packed = np.zeros(1, np.uint64)
    return {f"{name}head": np.array([n, low], np.int64), f"{name}low": packed, f"{name}high": words, f"{name}count": count, f"{name}one": np.append(ones[::SAMPLE] >> 6, len(words) - 1).astype(np.uint32), f"{name}zero": np.append(zeros[::SAMPLE] >> 6, len(words) - 1).astype(np.uint32)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str = ""):
        self.n, self.width = (int(x) for x in arrays[f"{name}head"])
        self.low, self.high, self.count, self.one, self.zero = (arrays[f"{name}{k}"] for k in ("low", "high", "count", "one", "zero"))

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero in the high bits."""
        sample = self.one if ones else self.zero
        word, last = sample[k >> SHIFT].astype(np.int64), sample[(k >> SHIFT) + 1].astype(np.int64)

        def before(w: np.ndarray) -> np.ndarray:
            counted = self.count[w].astype(np.int64)
            return counted if ones else 64 * w - counted

        open_ = np.flatnonzero(word < last)  # the last word with at most k before it
        while len(open_):
            w, end, want = word[open_], last[open_], k[open_]
            mid = (w + end + 1) >> 1
            inside = before(mid) <= want
            w, end = np.where(inside, mid, w), np.where(inside, end, mid - 1)
            word[open_], last[open_] = w, end
            open_ = open_[w < end]
        bits = self.high[word]
        return (word << 6) + select_in_word(bits if ones else ~bits, k - before(word))

    def _next(self, place: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero, given that of the one before it: mostly in the same word."""
        at = place + 1
        bits = self.high[at >> 6]
        bits = (bits if ones else ~bits) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((bits & (~bits + _U(1))) - _U(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            out[far] = self._select(k[far], ones)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
        return value & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = self._select(i, True) - i
        return high.astype(np.uint64) << _U(self.width) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those after them."""
        place = self._select(i, True)
        after = self._next(place, i + 1, True)
        return (place - i).astype(np.uint64) << _U(self.width) | self._low(i), (after - i - 1).astype(np.uint64) << _U(self.width) | self._low(i + 1)

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in [lo, hi) whose value is at least ``value``, or hi; whether it is equal).

        The run of values with the same high part is found by a selection and halved, however long it is.
        """
        high = (value >> _U(self.width)).astype(np.int64)
        low = value & _U((1 << self.width) - 1)
        inside = high <= self._top()
        rank = np.where(inside, high, 0)
        zero = np.full(len(value), -1)  # where the zero before the run stands
        later = np.flatnonzero(rank > 0)
        zero[later] = self._select(rank[later] - 1, False)
        start = np.where(inside, zero - rank + 1, self.n)
        end = np.where(inside, self._next(zero, rank, False) - rank if len(value) else rank, self.n)
        place, end = np.minimum(np.maximum(start, lo), hi), np.minimum(np.maximum(end, lo), hi)
        equal = np.zeros(len(value), bool)
        some = np.flatnonzero(place < end)
        seen, want = self._low(place[some]), low[some]
        equal[some] = seen == want
        more = some[(seen < want)]  # mostly few: runs of one high part are short
        place[more] += 1
        stop = end[more]
        at = place[more]
        open_ = np.flatnonzero(at < stop)
        while len(open_):  # halve what is left of the run
            mid = (at[open_] + stop[open_]) >> 1
            less = self._low(mid) < low[more[open_]]
            at[open_[less]] = mid[less] + 1
            stop[open_[~less]] = mid[~less]
            open_ = open_[at[open_] < stop[open_]]
        place[more] = at
        again = np.flatnonzero(at < end[more])
        equal[more[again]] = self._low(at[again]) == low[more[again]]
        return place, equal

    def _top(self) -> int:
        """The largest high part."""
        if not hasattr(self, "_last"):
            self._last = int(self.access(np.array([self.n - 1]))[0]) >> self.width if self.n else -1
        return self._last
