"""Word shingles as sorted 64-bit hashes, and MinHash signatures of them.

Runs inside tasks on Arrow batches; nothing here touches Spark.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
HASHES = 128
# Odd multipliers of the positions in a shingle (any odd 64-bit numbers do).
_PLACES = np.random.default_rng(20240517).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Word -> 64-bit hash, filled on demand and emptied when it grows too long."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of other bytes than ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles (uint64).

    Fewer words: one hash of the whole sequence. No words: empty.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        h = np.sum(h * _PLACES[:n], dtype=np.uint64, keepdims=True) + np.uint64(n)
        return _finish(h)
    total = h[: n - WIDTH + 1] * _PLACES[0]
    for k in range(1, WIDTH):
        total += h[k : n - WIDTH + 1 + k] * _PLACES[k]
    return np.unique(_finish(total))


class MinHasher:
    """HASHES minima of random linear permutations of the low 32 bits."""

    CHUNK = 1024

    def __init__(self, seed: int = 1, hashes: int = HASHES) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, hashes, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """uint32 signature of a non-empty set."""
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        best = None
        for start in range(0, len(low), self.CHUNK):
            part = (low[None, start : start + self.CHUNK] * self.a + self.b).min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x)) if len(x) else 0
