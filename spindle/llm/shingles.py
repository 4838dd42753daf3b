"""Words, hashed word shingles and MinHash, in numpy.

A word is a run of ``\\w`` in lower case. A shingle is five words in a row; a
text of one to four words has one shingle, all its words; a text without words
has none. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

SIZE = 5
WORD = re.compile(r"\w+")
#: MinHash values of a signature, and of one band of it.
HASHES, ROWS = 128, 4
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it has grown to its limit."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    return np.array([known[w] for w in WORD.findall(text.lower())], dtype=np.uint64) if text else np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit word over all of it."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hash of every shingle, in the order of the text."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        h ^= h >> np.uint64(32)
    return mix(h)


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    return np.unique(shingles(word_hashes(text, known)))


def set_key(unique: np.ndarray) -> bytes | None:
    """128 bits that tell shingle sets apart; None for the empty set."""
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest() if len(unique) else None


def signature(unique: np.ndarray) -> np.ndarray:
    """MinHash values as uint32."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(unique), 512):
        np.minimum(low, (unique[i : i + 512, None] * FACTORS + SHIFTS).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)
