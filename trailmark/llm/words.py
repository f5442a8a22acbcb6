"""Words and hashes of whole texts, in vectors, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z in lower case; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LIMIT = 300_000
#: Windows that are hashed at once, so that what is in between stays in the cache.
BLOCK = 1 << 14


class WordHashes(dict):
    """64-bit hash of each word; forgets all at ``_LIMIT`` words, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _LIMIT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))  # a new array, which the rest changes in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at just these six bytes, and none is part of another UTF-8 character."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(LOWER) if lower else data).split()


def hashed(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words, in order; of the whole sequence where there are fewer."""
    k = min(n, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, np.uint64(k))
    for low in range(0, len(out), BLOCK):
        x = out[low : low + BLOCK]
        for i in range(k):
            x = x * np.uint64(0x9E3779B97F4A7C15)
            x += h[low + i : low + i + len(x)]
            x = mix(x)
        out[low : low + BLOCK] = x
    return out
