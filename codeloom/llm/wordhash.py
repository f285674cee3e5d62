"""Hashes of words and of runs of words over UTF-8 buffers, in numpy; no Python object per word is made.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside another character,
so this is `[^\\x20\\x09-\\x0D]+` on the text.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SEP] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLACE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of each word."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, a segment of about a megabyte at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, "right")))
        lo, hi = starts[at], ends[to - 1]
        first = starts[at:to] - lo
        length = np.diff(np.append(first, hi - lo))
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(first, length)
        values = _BYTE[data[lo:hi]]
        values *= powers(_PLACE, int(length.max()))[place]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    return mix(out)


def run_hashes(hashes: np.ndarray, length: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """The hash of each run of `length` consecutive values, at its first place; empty if there are too few."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=summed[1:])
    back = powers(pow(base, -1, 1 << 64), n)[: n - length + 1]
    return mix((summed[length:] - summed[:-length]) * back)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's words begin, and the end, from the sorted row of each word."""
    return np.searchsorted(rows, np.arange(n + 1))
