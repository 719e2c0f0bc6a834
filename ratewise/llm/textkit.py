"""Vectorised hashing of UTF-8 text in numpy: whole Arrow slices at once.

Polynomial hashes modulo 2**64 over a random byte table, taken from one prefix
sum, so the hash of any byte range costs O(1).  Every hash is finished with a
64-bit mixer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=U)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        # keep at most a few megabytes between slices
        if n <= 1 << 23:
            _powers[name] = grown
        have = grown
    return have[:n]


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


class Prefix:
    """Prefix sums from which ``ranges`` hashes any ranges of bytes, or of
    64-bit values (word hashes)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U)
        values = _TABLE[data] if data.dtype == np.uint8 else data
        np.cumsum(values * _power(_BASE, n, "up"), out=self.sums[1:])
        self.down = _power(_INV, n + 1, "down")

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Hash of data[i:i+width] for every i that has one."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the slice
    ends: np.ndarray
    first: np.ndarray   # first[d]:first[d+1] are the words of text d


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of bytes other than space and \\t..\\r of each text."""
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(offsets), np.int64))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of ``width`` consecutive entries, for each start
    that has them (texts are not told apart; callers mask the crossings)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        # doubling: h of 2m entries from two of m, then the rest by its bits
        out, have, block, m = None, 0, hashes, 1
        rest = width
        while rest:
            if rest & 1:
                out = block.copy() if out is None else mix(out[:len(hashes) - (have + m) + 1] * U(_BASE) + block[have:])
                have += m
            rest >>= 1
            if rest:
                block = mix(block[:len(block) - m] * U(0xC2B2AE3D27D4EB4F) + block[m:])
                m *= 2
        return out


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest (by its high 32 bits) of each
    ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low32 = U(0xFFFFFFFF)
    x = (values & ~low32) | np.arange(len(values), dtype=U)
    m = 1
    while m * 2 <= width:  # minimum of 2m from two of m
        x = np.minimum(x[m:], x[:len(x) - m])
        m *= 2
    if m < width:
        x = np.minimum(x[width - m:], x[:len(x) - (width - m)])
    return (x & low32).astype(np.int64)


class Runs(NamedTuple):
    """Runs of consecutive windows of one text that share an anchor."""
    anchor: np.ndarray  # position of the anchor
    low: np.ndarray     # first window start
    high: np.ndarray    # last window start


def runs(grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> Runs:
    """The anchor of a window is its smallest gram, leftmost if tied, so equal
    windows have equal anchors at equal places, wherever they stand.
    ``first[d]:first[d+1]`` are the units of text d."""
    at = minima(grams, window - gram + 1)
    valid = np.zeros(len(at), bool)
    size = np.diff(first)
    long = size >= window
    # windows of a text start at first[d] .. first[d+1] - window
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, first[:-1][long], 1)
    np.add.at(edge, np.minimum(first[1:][long] - window + 1, len(at)), -1)
    valid = np.cumsum(edge[:-1]) > 0
    starts = np.flatnonzero(valid)
    if not len(starts):
        zero = np.zeros(0, np.int64)
        return Runs(zero, zero, zero)
    m = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    return Runs(m[begin], starts[begin], starts[end])
