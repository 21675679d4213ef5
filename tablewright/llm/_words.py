"""Words, word hashes and window hashes on the Arrow side.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. ``bytes.split()`` cuts at exactly these six bytes
(``str.split()`` would also cut at no-break spaces and separators), so texts travel as UTF-8 binary.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def as_utf8(col: str | Column) -> Column:
    return F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")


def split_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class WordHashes(dict):
    """64-bit hashes by word; emptied at ``limit`` entries so a long task stays in bounded memory."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, by the position of its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out, power = np.zeros(count, dtype=np.uint64), 1
    for k in range(n):
        power = power * 0x9E3779B97F4A7C15 & _MASK
        out += hashes[k : k + count] * np.uint64(power)
    return mix(out)
