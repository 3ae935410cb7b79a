"""Small numpy helpers on words and 64-bit hashes, used inside Arrow batches.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text; on UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift rounds) on a uint64 array."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


class WordIds(dict):
    """Word bytes -> 64-bit hash, remembered up to ``limit`` words (then forgotten and recomputed)."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per window of n word ids, in order; empty if there are fewer than n words."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    c = odd_constants(n, 17 * n)
    acc = ids[:m] * c[0]
    for i in range(1, n):
        acc = acc + ids[i : i + m] * c[i]
    return mix(acc)


def shingle_set(ids: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingle hashes; a shorter text counts whole as one shingle; no words, no shingle."""
    if not len(ids):
        return np.empty(0, np.uint64)
    if len(ids) < n:
        return gram_hashes(ids, len(ids))
    return np.unique(gram_hashes(ids, n))
