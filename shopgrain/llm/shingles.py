"""Word shingles of whole texts as 64-bit numbers, and MinHash values of their sets."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
SIZE = 5
#: Words whose numbers a worker keeps.
CACHED = 400_000

_WORDS = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that any bits of the result may be used alone."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """Distinct shingles, sorted.  Words are lower-case runs of letters and digits.

    A text of fewer words than a shingle has one shingle, of all its words; a
    text without words has none.
    """
    words = _WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    numbers = list(map(_known.get, words))
    if None in numbers:
        for i, n in enumerate(numbers):
            if n is None:
                if len(_known) >= CACHED:
                    _known.clear()
                numbers[i] = _known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    of = np.array(numbers, np.uint64)
    n = min(size, len(of))
    folded = np.full(len(of) - n + 1, n, np.uint64)
    for i in range(n):
        folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + of[i : len(of) - n + 1 + i])
    return np.unique(folded)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


class MinHash:
    """``n`` minima of a set under hash functions drawn from a seed."""

    def __init__(self, n: int, seed: int = 1) -> None:
        drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64)
        self.by = (drawn * np.uint64(2) + np.uint64(1))[:, None]

    def values(self, shingles: np.ndarray, at_once: int = 4096) -> np.ndarray:
        least = np.full(len(self.by), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), at_once):
            np.minimum(least, (self.by * shingles[None, i : i + at_once]).min(1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)
