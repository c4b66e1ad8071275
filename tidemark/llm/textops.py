"""Vectorised hashing of bytes, words and shingles with numpy.

A text is UTF-8 bytes. Words are maximal runs without ``[\\x20\\x09-\\x0D]``. All hashes are functions of
content alone: the same on every executor and in every run.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; grown as needed and kept by the worker."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n - 1).bit_length()), U64(base), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[str(base)] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    return _table(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _table(pow(_BASE, -1, 1 << 64), n)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of value(byte i) * base ** i for s <= i < e."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal content wherever it stands."""
    return mix((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start] + (end - start).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row its first word's index (one more entry than rows)."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~is_space(data)
    starts, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    bounds = offsets[1:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] |= solid[inner + 1]
    ends[inner - 1] |= solid[inner]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(word_hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, the index of each window's first word, and row bounds among the windows."""
    n = len(word_hashes) - size + 1
    counts = np.maximum(np.diff(rows) - size + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0 or not bounds[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), bounds * 0
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += word_hashes[j : n + j] * U64((2 * j + 3) * 0xD6E8FEB86659FD93 & _MASK | 1)
    first = np.repeat(rows[:-1], counts) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts))
    return mix(total[first]), first, bounds
