"""Words and five-word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of anything but ASCII white space, control characters and punctuation, in lower case. Equal words have
equal hashes; different ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

SPACES = bytes(32 if chr(i) in string.punctuation or i < 32 or i == 127 else i for i in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads neighbours; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: bytes, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of bytes that ``is_space`` (256 booleans) does not hold."""
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~is_space[a]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends


def normalised(text: str | None) -> bytes:
    """Lower case as UTF-8, with ASCII punctuation and control characters as spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACES)


_BLANK = np.zeros(256, bool)
_BLANK[32] = True


@dataclass
class Words:
    """Hashes of the words of several texts, one text after another; ``bounds`` has their places."""

    hashes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Words:
        parts = [normalised(t) for t in texts]
        found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in batches_of([len(p) for p in parts], 1 << 17):  # what lies between stays in the processor's cache
            hashes, starts, _ = word_hashes(b" ".join(parts[a:b]), _BLANK)
            found.append(hashes)
            sizes.append(np.diff(np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts[a:b]])), prepend=0))
        return cls(np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds) of runs of ``width`` words in each text, in order, repeats kept. A shorter text that has words is one shingle."""
        n, counts = len(self.hashes), np.diff(self.bounds)
        full = np.zeros(n, np.uint64)
        for j in range(width):
            part = self.hashes[j:] * np.uint64((2 * j + 3) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1 | 1)
            full[: n - j] += part
        full = mix64(full)
        text_of = np.repeat(np.arange(len(counts)), counts)
        left = self.bounds[1:][text_of] - np.arange(n)  # words from here to the end of the text
        keep = left >= width
        short = np.flatnonzero((counts > 0) & (counts < width))
        for i in short:
            a, b = self.bounds[i], self.bounds[i + 1]
            keep[a] = True
            with np.errstate(over="ignore"):
                value = np.uint64(b - a)
                for h in self.hashes[a:b]:
                    value = value * np.uint64(BASE) + h
            full[a] = mix64(np.array([value], np.uint64))[0]
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        return full[keep], np.concatenate([[0], np.cumsum(sizes)])


def batches_of(lengths: Sequence[int], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters together, single longer texts by themselves: bounds memory."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out
