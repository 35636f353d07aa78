"""Hashes of runs of bytes and words of one text, for whole arrays at once (64 bit).

A run's hash is sum(value[j] * BASE**(j - start)) modulo 2**64 over random values of
its bytes, read from prefix sums; ``mix`` spreads it over all bits."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
STEP = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j for j < n, kept per worker and grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.ones(size, dtype=np.uint64)
            np.multiply.accumulate(np.full(size - 1, base, dtype=np.uint64), out=out[1:])
            _powers[i : i + 1] = [out]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end), its length included."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of UTF-8 text, in order."""
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_bounds(data)
    return run_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends)


def gram_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values; of all of them if there are fewer."""
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(max(1, n - width + 1))
    return run_hashes(prefix_sums(mix(values)), starts, np.minimum(starts + width, n))
