"""Vectorised word scanning over Arrow string columns.

Texts stay in Arrow's UTF-8 buffer; one numpy pass finds the words of many rows at a time.  A word
is a maximal run of word bytes inside one row.  The separator classes used here are ASCII, so byte
scanning agrees with code point scanning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
CHUNK_BYTES = 1 << 18

#: Byte classes: words between white space, and words of letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
ALNUM_CASED = ALNUM[LOWER]

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[LOWER]
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_P, _PINV):
            a = np.full(size, base, _U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=_U))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of rows ``lo .. hi-1``: byte offsets into ``buf`` and each row's slice of them."""

    lo: int
    hi: int
    buf: np.ndarray
    row_start: np.ndarray
    row_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def hashes(self, lower: bool) -> np.ndarray:
        """One 64-bit hash per word: a polynomial over random byte values, then a finaliser."""
        up, down = _power_tables(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.buf] * up[: len(self.buf)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def chunks(column: pa.Array, word_bytes: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a string column, at least a row and about ``size`` bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        base = int(off[lo])
        buf = raw[base : int(off[hi])]
        row_start, row_end = off[lo:hi] - base, off[lo + 1 : hi + 1] - base
        inside = word_bytes[buf]
        begins, ends = inside.copy(), inside.copy()
        if len(buf):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = row_start[(row_start > 0) & (row_start < len(buf))]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        yield Words(lo, hi, buf, row_start, row_end, start, end, np.searchsorted(start, row_start), np.searchsorted(start, row_end))
        lo = hi
    del column, data, offsets, raw, off
    pa.default_memory_pool().release_unused()


def code_point_prefix(buf: np.ndarray) -> np.ndarray:
    """``out[i]``: code points that start before byte ``i``."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out
