"""Word shingles and MinHash values of a text, over whole byte buffers at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(seed)) | _U(1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and their inverses modulo 2^64, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: prefix sums of bytes times powers, brought to a common offset."""
    up, down = _grown(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def word_hashes(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    return hash_ranges(buf, *word_bounds(buf))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    total = np.full(n, k, _U)
    for j, c in enumerate(constants(k, 11)):
        total += words[j : j + n] * c
    return mix(total)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles, A-Z in lower case.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    if not text:
        return np.empty(0, _U)
    words = word_hashes(text.lower())  # bytes: changes A-Z only
    if 0 < len(words) < k:
        return ngram_hashes(words, len(words))
    return np.unique(ngram_hashes(words, k))


def min_hashes(shingles: np.ndarray, multipliers: np.ndarray, adders: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each function x -> a x + b the least value over the set, in blocks, so long texts need no more memory."""
    least = np.full(len(multipliers), np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), block):
        part = shingles[at : at + block]
        np.minimum(least, (part[None, :] * multipliers[:, None] + adders[:, None]).min(axis=1), out=least)
    return least


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    return tuple(int(mix(shingles + _U(c)).sum(dtype=_U).view(np.int64)) for c in (0x1B873593, 0xCC9E2D51))
