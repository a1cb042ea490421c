"""Words of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Odd multiplier of the polynomial over word hashes.
BASE = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Hash of a word, kept for up to ``most`` words; 0 is left for separators."""

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text: runs of letters, digits and underscores, in lower case; none for null."""
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hash of every ``size`` consecutive words, its bits mixed."""
    n = max(len(words) - size + 1, 0)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        keys *= np.uint64(BASE)
        keys += words[i : i + n]
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(29)
    return keys


_HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Word hashes by this worker's cache."""
    return _HASHES.of(text)
