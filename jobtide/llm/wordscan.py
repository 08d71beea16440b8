"""Words, their hashes and line borders of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every value scattered over 64 bits."""
    x = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling polynomial hash of ``values[start:end]``, the same wherever the range lies."""
    prefix = np.r_[np.uint64(0), np.cumsum(mixed(values) * powers(BASE, len(values)))]
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, len(values) + 1)[start]
    return mixed(h ^ ((end - start).astype(np.uint64) * np.uint64(BASE)))


def is_space(points: np.ndarray) -> np.ndarray:
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of true values, none reaching over a text's border."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[borders < len(inside)]
    first[borders] = inside[borders]
    before = borders[borders > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
