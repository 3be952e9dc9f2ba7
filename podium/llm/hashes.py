"""Hashes of many stretches of bytes at once, from running sums of the bytes' values times powers of a base, modulo 2^64.

The sum over a stretch, taken back to the power of its first byte, depends on its bytes alone. Values of bytes are fixed random numbers
and the base is 5 modulo 8, so different stretches have equal hashes about as rarely as with other 64-bit hashes; a caller for whom that is not
enough compares what it finds.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 16
_INVERSE = pow(BASE, -1, 1 << 64)
#: A value for each byte; those of capitals are those of small letters in LOWER.
VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = VALUES[[x + 32 if 65 <= x <= 90 else x for x in range(256)]]


def _powers(base: int) -> np.ndarray:
    """base^k for k below BLOCK."""
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def sums(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Running sums over bytes, from 0 (one more entry than bytes)."""
    terms = values[data]
    for k in range(0, len(terms), BLOCK):
        part = terms[k : k + BLOCK]
        part *= _UP[: len(part)]
        if k:
            part *= np.uint64(pow(BASE, k, 1 << 64))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def of_grams(running: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of `size` bytes, mixed."""
    h = running[size:] - running[:-size]
    for k in range(0, len(h), BLOCK):
        part = h[k : k + BLOCK]
        part *= _DOWN[: len(part)]
        if k:
            part *= np.uint64(pow(_INVERSE, k, 1 << 64))
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def of_stretches(running: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes from begin to end, mixed with its size."""
    high = np.array([pow(_INVERSE, k, 1 << 64) for k in range(0, len(running), BLOCK)], np.uint64)
    h = running[end] - running[begin]
    h *= _DOWN[begin % BLOCK]
    h *= high[begin // BLOCK]
    return mixed(h + (end - begin).astype(np.uint64) * _M2)
