"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Scrambled numbers as fractions in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes of words; those met first are kept, up to a bound."""

    def __init__(self, kept: int = 500_000):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.kept:
            self[word] = found
        return found


def shingle_set(text: str | None, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of the lower-cased text.

    Words are separated by white space. A text of fewer words has one shingle,
    of all of them; a null or blank text has none.
    """
    parts = (text or "").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(w) - width + 1)
    h = w[:n].copy()
    for k in range(1, min(width, len(w))):
        h *= MULTIPLIER
        h += w[k : k + n]
    return np.unique(mix(h, len(w) if len(w) < width else 0))
