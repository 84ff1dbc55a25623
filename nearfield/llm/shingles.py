"""Hashed word n-grams of whole texts, for Python workers."""

import numpy as np
import xxhash

from nearfield.llm.common import ascii_words

#: A worker forgets the hashes of words it knows when it knows so many; they are computed again.
_KNOWN = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, n: int = 4) -> np.ndarray:
    """Distinct 64-bit hashes of the ``n``-word shingles in ascending order; of the whole sequence when it is shorter;
    none without words."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = word_hashes(words)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _A + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(31)
    out *= _B
    out ^= out >> np.uint64(29)
    return np.unique(out)
