"""Texts of an Arrow batch as byte arrays: slices, words, hashes.

A batch of any size is worked on in slices of a few MB of text, so that a task's memory
depends on its longest text and not on the number of rows that arrive together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# Odd multipliers of polynomial hashes modulo 2**64, and the mixer's constants.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def _word_bytes() -> np.ndarray:
    """Per byte its lower-cased form if it belongs to a word, else 0.

    Words are made of digits, ASCII letters and every byte of a non-ASCII character.
    """
    table = np.zeros(256, np.uint8)
    for low, high, shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 32), (0x80, 0xFF, 0)):
        for b in range(low, high + 1):
            table[b] = b + shift
    return table


WORD_BYTES = _word_bytes()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch, each run holding about `limit` bytes of text or one row."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(column))[1][1:]
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows joined, and the n + 1 bounds of the rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class PowerTables:
    """Powers of a base and of its inverse, grown as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse_base = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sized(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse_base, n)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: PowerTables) -> np.ndarray:
    """Hash of values[start:end] for each range; equal contents have equal hashes anywhere."""
    up, down = tables.sized(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def token_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` bytes that stay within a row.

    Returns starts, ends (exclusive) and, per row, the number of its first run (n + 1 values).
    """
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rows = bounds[:-1][bounds[:-1] < bounds[1:]]  # starts of rows that are not empty
    fresh[rows] = inside[rows]
    closing = rows[1:] - 1
    last[closing] = inside[closing]
    starts = np.flatnonzero(fresh)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 between words), word starts, word ends, first word of each row."""
    low = WORD_BYTES[data]
    return low, *token_bounds(low != 0, bounds)


def windows_in_rows(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words at which a window of n words starts that stays within its row."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    inside = np.ones(total, bool)
    for back in range(1, n):  # the last n - 1 words of each row start no window
        ends = first[1:] - back
        inside[ends[ends >= first[:-1]]] = False
    return np.flatnonzero(inside)
