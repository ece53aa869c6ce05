"""Word and shingle hashing shared by the operators that run Python."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


class WordHashes(dict):
    """64-bit hash by word (bytes); forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (given by their hashes), in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * U64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix64(out + U64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles, sorted; fewer than ``k`` words make one shingle, none make none."""
    return np.unique(shingles(words, min(k, len(words)))) if len(words) else np.empty(0, U64)
