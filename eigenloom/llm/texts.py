"""Shared numpy kernels over the UTF-8 bytes of an Arrow batch: words, hashes, window hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# An odd multiplier and its inverse modulo 2^64: prefix sums of byte * base^i then give any substring's hash.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]

# Numbers for every byte at each of the first places of a word.
PLACES = 64
PLACED_CODES = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))).reshape(PLACES, 256)

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if size <= 4 * SLICE_BYTES:
            _tables[base] = table
    return table[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of code_i * BASE^i, from 0."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal spans wherever they start; the length takes part."""
    inverse = powers(UNBASE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """The hash of every stretch of ``width`` codes, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * powers(UNBASE, n) + np.uint64(width))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of rows: byte spans within ``data``, row index, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        return span_hashes(prefix_sums(codes[self.data]), self.starts, self.ends)

    def word_hashes(self) -> np.ndarray:
        """The hash of each word: a sum of numbers drawn for its bytes and their places, so that no arrangement
        of bytes cancels out as it can in a polynomial modulo 2^64."""
        size = self.ends - self.starts
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        byte = self.data[np.repeat(self.starts, size) + place]
        drawn = PLACED_CODES[np.minimum(place, PLACES - 1), byte]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            drawn[far] = mix(drawn[far] + place[far].astype(np.uint64) * np.uint64(BASE))
        return mix(np.add.reduceat(drawn, begin) + size.astype(np.uint64))

    def joined(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The words with one space between them, and where each begins and ends."""
        size = self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        flat = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        begin = ends - size
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + place] = self.data[np.repeat(self.starts, size) + place]
        return memoryview(flat.tobytes()), begin, ends

    def index_in_row(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D, none crossing rows."""
    n_rows, size = len(offsets) - 1, len(data)
    inside = np.zeros(size + 2, bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    return Words(data, starts, ends, row, first)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def spans_to_mask(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True where any of the half-open spans covers."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())
