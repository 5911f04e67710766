"""Word shingles as 64-bit hashes, in numpy on the Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Words whose hash a worker remembers.
MEMO = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (bytes.split and bytes.lower know ASCII only)."""
    return (text or b"").lower().split()


def shingle_stream(found: list[bytes], memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles in order, repeats included; fewer words than ``width`` make one shingle of all, none make none."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(w) - width + 1)
    total = np.full(n, min(len(w), width), dtype=np.uint64)
    for k in range(min(width, len(w))):
        total += mix(w[k : k + n] + _ODD[k % 5]) * _ODD[(k + 1) % 5] * np.uint64(2 * (k // 5) + 1)
    return mix(total)


def shingle_set(text: bytes | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_stream(words(text), memo, width))
