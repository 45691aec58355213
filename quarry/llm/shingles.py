"""64-bit hashes of words and shingles, whole arrays at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker's cache may hold before it starts anew.
CACHE_WORDS = 50_000
WORDS_PER_SHINGLE = 5

def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd multipliers for the places of a shingle, without linear relations between them.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_shingles(words: list[bytes], k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of a shorter text the
    one hash of its whole sequence; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < k:
        h = (w * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
    else:
        h = w[: n - k + 1] * PLACES[0]
        for i in range(1, k):
            h = h + w[i : n - k + 1 + i] * PLACES[i]
    return np.unique(mixed(h))
