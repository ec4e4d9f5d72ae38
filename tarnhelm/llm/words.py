"""Words of whole Arrow string columns as numpy arrays: bounds, 64-bit hashes, and hashes of runs of words.

All functions work on UTF-8 bytes. Separators are ASCII, so a byte-wise split equals a split by code points.
Hashes are 64 bits of a chained mixer over the word's bytes; equal words have equal hashes, and unequal words
share one with probability 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of ``[^\x20\x09-\x0D]+``.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser: each bit of the input reaches all bits of the output."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; text i has bytes[offsets[i]:offsets[i + 1]]."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): bytes of each word; text i has the words bounds[i]:bounds[i + 1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    h = mix(length.astype(U) * U(_BASE))
    h = mix(h ^ (eight[start] & _MASK[np.minimum(length, 8)]))
    rest, k = np.flatnonzero(length > 8), 8
    while len(rest):
        left = length[rest] - k
        h[rest] = mix(h[rest] ^ (eight[start[rest] + k] & _MASK[np.minimum(left, 8)]))
        rest, k = rest[left > 8], k + 8
    return h


def powers(base: int, n: int) -> np.ndarray:
    if len(have := _powers.get(base, ())) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


class Runs:
    """Hashes of any runs of consecutive words, from prefix sums of the words' hashes."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(_BASE, len(h)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def run_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Where runs of ``k`` words start that lie within one text."""
    n = int(bounds[-1])
    if n < k:
        return np.zeros(0, np.int64)
    fits = np.zeros(n + 1, np.int32)
    has = bounds[1:] - bounds[:-1] >= k
    np.add.at(fits, bounds[:-1][has], 1)
    np.add.at(fits, bounds[1:][has] - k + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:-1]) > 0)
