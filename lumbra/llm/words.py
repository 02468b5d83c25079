"""Words, shingles and 64-bit hashes of whole texts, as numpy arrays.

A word is a longest run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  UTF-8 codes non-ASCII characters by bytes of 128
and above only, so the same class over bytes gives the same words.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Bytes of a word to themselves in lower case, all others to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Words whose hash a worker remembers; beyond it starts afresh.
_REMEMBERED = 200_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order; null counts as empty.  Lone surrogates can't occur in Spark strings."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashed: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` words, in order, repeats kept.

    A text of fewer words has one shingle, of all its words; a text of none has none.
    """
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        step = _STEPS[k % 5] + np.uint64(2 * (k // 5))
        out = (out + hashed[k : n - width + 1 + k]) * step
        out ^= out >> np.uint64(29)
    return mix(out)
