"""Vectorised text kernels shared by the operators.

A batch of texts is one byte array with row offsets. Strings are compared by
64-bit polynomial fingerprints (byte values replaced by fixed random words, odd
base, arithmetic modulo 2**64, finalised); two different strings agree with a
probability of about 2**-64, which all users of this module accept as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 4096), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


class Prints:
    """Fingerprints of any substring of one sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * powers(INVERSE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(BASE, len(self.sums))[start])

    def grams(self, k: int) -> np.ndarray:
        """Fingerprints of all substrings of k symbols."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * powers(BASE, n))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes at most: first row, end row, bytes, offsets."""
    data, at = texts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a row boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = inside & cut[:n]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & cut[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds (n + 1 indexes, ascending)."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def list_of(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(flat, kind))


def spans_count(cover: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Maximal True runs in each row."""
    start = cover.copy()
    start[1:] &= ~cover[:-1]
    inner = bounds[:-1][(bounds[:-1] < len(cover)) & (bounds[:-1] < bounds[1:])]
    start[inner] |= cover[inner]
    return per_row(start, bounds)
