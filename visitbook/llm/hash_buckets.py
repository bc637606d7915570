"""Counting hashed keys in buckets, and Bloom filters whose segments belong to the buckets.

A key's bucket is given by its leading bits, so a task's sorted keys fall into buckets as
consecutive runs, and the keys of one bucket pack into small differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from visitbook.llm import text_arrays as ta

# Keys that a task gathers before it hands them on.
HELD_KEYS = 1 << 21
PROBES = 4


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts of hashed keys, merged whenever `held` have come in."""

    def __init__(self, held: int = HELD_KEYS):
        self.held = held
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(self.held, 2 * self.merged):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        merged = add_up(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts = [merged]
        self.waiting = self.merged = len(merged[0])
        return merged


def bucket_starts(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_starts(buckets), keys, side="right") - 1


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences and counts, each in the narrowest type that holds them."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[:1] = 0  # the first key stands apart
    narrow = len(steps) == 0 or steps.max() < 1 << 32
    sizes = (np.uint8, np.uint32, np.uint64)
    count_type = next(t for t in sizes if counts.max(initial=0) <= np.iinfo(t).max)
    head = np.array([len(keys), keys[0] if len(keys) else 0], np.uint64)
    return head.tobytes() + steps.astype(np.uint32 if narrow else np.uint64).tobytes(), counts.astype(count_type).tobytes()


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first = np.frombuffer(keys[:16], np.uint64)
    n = int(n)
    steps = np.frombuffer(keys[16:], np.uint64 if len(keys) - 16 == 8 * n else np.uint32).astype(np.uint64)
    kinds = {1: np.uint8, 4: np.uint32, 8: np.uint64}
    values = np.frombuffer(counts, kinds[len(counts) // n] if n else np.uint8).astype(np.int64)
    return first + np.cumsum(steps, dtype=np.uint64), values


def places(ids: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The PROBES places of (id, level) in a segment."""
    h = ta.mix(ids + np.uint64(level * ta.BYTE_BASE % (1 << 64)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (h >> np.uint64(8)) % np.uint64(bits)
        h = h + step * np.uint64(ta.WORD_BASE)


def enter(field: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at these places of a segment."""
    np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def present(field: np.ndarray, bucket: np.ndarray, ids: np.ndarray, level: int) -> np.ndarray:
    """Whether all places of (id, level) are set in the segments of the ids' buckets."""
    found = np.ones(len(ids), bool)
    for at in places(ids, level, field.shape[1] * 8):
        at = at.astype(np.int64)
        found &= (field[bucket, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found
