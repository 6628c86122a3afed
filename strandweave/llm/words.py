"""Vectorised words and rolling hashes over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text. All hashes are polynomials modulo 2^64 with an odd base, which has an
inverse: prefix sums give the hash of any span by one subtraction and one
multiplication.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; other salts give other hashes."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 12, n + n // 8)
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up[:n], self.down[:n]


_byte_powers = _Powers(BYTE_BASE)
_word_powers = {base: _Powers(base) for base in WORD_BASES}


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: _Powers) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for every span."""
    up, down = table(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Texts:
    """Texts of some rows: their bytes and, by row, where each one starts."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def words(self) -> "Words":
        """All words, in order; none spans two rows."""
        solid = ~SPACE[self.data]
        filled = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.zeros(len(solid) + 1, dtype=bool)
        before[1:] = solid
        first = solid & ~before[:-1]
        first[filled] = solid[filled]
        after = np.zeros(len(solid), dtype=bool)
        after[:-1] = solid[1:]
        lasts = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        after[lasts] = False
        starts, ends = np.flatnonzero(first), np.flatnonzero(solid & ~after) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


@dataclass
class Words:
    """Words as byte spans; row r has words offsets[r] .. offsets[r+1]-1."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        values = self.texts.data.astype(np.uint64) + np.uint64(1)
        return mixed(span_hashes(values, self.starts, self.ends, _byte_powers))

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def windows(self, size: int, hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of size words within a row, and their hashes."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        last = np.repeat(self.offsets[1:], np.diff(self.offsets))
        at = np.arange(n, dtype=np.int64)
        at = at[at + size <= last]
        return at, mixed(span_hashes(hashes, at, at + size, _word_powers[WORD_BASES[which]]), which + 1)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The texts of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64))
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and serves later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column`, or one row.

    This bounds the memory of numpy work by the bytes and not by the rows. What is free
    after the last of them goes back to the system.
    """
    for batch in batches:
        offsets = texts_of(batch.column(batch.schema.get_field_index(column))).offsets
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
