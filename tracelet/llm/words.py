"""Words of a text as 64-bit hashes, for the operators that compare texts by words."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_MOST = 200_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class WordHashes(dict):
    """Hashes of words (bytes); strip: without these bytes at both ends, and 0 for a word of nothing else. Bounded."""

    def __init__(self, strip: bytes = b""):
        super().__init__()
        self.strip = strip

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_MOST:
            self.clear()
        core = word.strip(self.strip) if self.strip else word
        out = self[word] = (xxhash.xxh64_intdigest(core) or 1) if core else 0
        return out

    def of(self, text: str) -> np.ndarray:
        """A-Z in lower case, cut at ASCII white space."""
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MULTIPLIERS[0]
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words at each place; of all words if there are fewer; nothing without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        h = np.full(1, n, np.uint64)
        for w in words:
            h = mix(h * MULTIPLIERS[1] + w)
        return h
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * MULTIPLIERS[1] + words[j : j + len(h)])
    return h
