"""Words of a text and their hashes, in numpy, for operators on shingles and windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z in UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words whose hashes a worker keeps.
CACHED, CACHED_LENGTH = 100_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of other bytes than blank and \\x09-\\x0D, as UTF-8; none for NULL."""
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    if k <= 8:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += word_hashes[j : j + n] * factors[j]
        return mix(total)
    # long runs: a polynomial of the words, by prefix sums
    base, inverse = 0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)
    powers = _powers(base, len(word_hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(word_hashes) * powers, dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * _powers(inverse, n))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, n.bit_length())
        got = np.ones(size, dtype=np.uint64)
        got[1:] = np.cumprod(np.full(size - 1, base, dtype=np.uint64))
        _POWERS[base] = got
    return got[:n]
