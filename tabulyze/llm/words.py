"""Words and shingles of an Arrow text column as numpy arrays, without Python strings.

A word is a run of bytes other than blank and 0x09 to 0x0D. Hashes are polynomial in
64-bit arithmetic and then mixed, so equal text has equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = [np.uint64(v) for v in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                               0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            table = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly; every salt gives another order."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes; entry i covers the bytes before i."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each row (n + 1)."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    after = np.concatenate((space[1:], [True])) if len(data) else space
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_rows(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes). A row with fewer words than ``width`` has its
    whole sequence as its one shingle; a row without words has none."""
    data, offsets = bytes_of(column)
    for first, last in row_chunks(offsets):
        part = _LOWER[data[offsets[first]:offsets[last]]]
        own = offsets[first:last + 1] - offsets[first]
        starts, ends, row_word = word_bounds(part, own)
        words = word_hashes(part, starts, ends)
        span = len(words) - width + 1
        if span > 0:
            grams = words[:span] * STEP[0]
            for k in range(1, width):
                grams = grams + words[k:k + span] * STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
            grams = mix(grams)
        for row in range(first, last):
            a, b = row_word[row - first], row_word[row - first + 1]
            if b - a >= width:
                yield row, np.unique(grams[a:b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for k in range(a, b):
                    short = mix(np.array([short ^ words[k]], np.uint64), 7)[0]
                yield row, np.array([short], np.uint64)
            else:
                yield row, np.zeros(0, np.uint64)
