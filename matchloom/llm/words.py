"""Words and rolling hashes of many texts at once, in NumPy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks every ASCII byte that is neither letter nor digit.
LETTERS = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def blank_words(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, LF, VT, FF and CR, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def blank_words_lower(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for frequent words within a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every k consecutive words: one entry for each start."""
    n = max(0, len(hashes) - k + 1)
    value = hashes[:n].copy()
    for j in range(1, k):
        value *= _BASE
        value += hashes[j : j + n]
    return mix(value)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive entries, by doubling."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if width < k else x
