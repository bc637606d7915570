"""Removal of repeated byte strings by blockwise suffix sorting.

Every LENGTH-byte string that also starts earlier is removed, byte by byte. The suffixes to
compare are put into buckets such that equal strings meet: a suffix belongs to the bucket of
its anchor, the lowest hashing K bytes within its first LENGTH bytes. Most anchors are unique
in the corpus; a first pass counts them, and a filter of the repeated ones spares their
suffixes the sort.

Buckets are sorted one after the other. Within a bucket suffixes begin at a known distance
from their anchor, and the texts lie aligned on it. A difference cover of the residues modulo
PERIOD marks the sample places, whose next SAMPLE bytes are named once. Two suffixes are told
apart by the few bytes up to the first sample place, the names of two samples that reach over
the rest, and the few bytes after them: long ties cost no more than short ones, and memory is
that of one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta
from visitbook.llm.hash_buckets import HELD_KEYS, Tally, add_up, bucket_of, bucket_starts, enter, packed, places, present, unpacked
from visitbook.session import settle

LENGTH = 100
ANCHOR = 50  # bytes of an anchor
SAMPLE, PERIOD = 50, 32  # bytes named at a sample place; period of the cover
SLICE_BYTES = 1 << 19
HELD = HELD_KEYS // 2  # anchors that a counting task gathers
PLACE_BITS = np.uint64(28)  # of a place within a slice
# Segments sorted together, and the most that one anchor may have without being hot.
BLOCK_SEGMENTS, HOT_SEGMENTS = 1 << 14, 1 << 15
# Segments that a task hands on together, and that a bucket is meant to hold.
PACK_SEGMENTS, BUCKET_SEGMENTS = 1 << 15, 1 << 16
# At most so many anchors are hot: the bound of a block grows before this list does.
HOT_ANCHORS = 1 << 20
# Largest filter of repeated anchors, in bits; beyond it they are joined instead.
FILTER_BITS = 1 << 28
ENTRY_BITS = 8
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 16


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo `period` is one of two of them: greedy."""
    cover, missing = [0], set(range(1, period))
    while missing:
        def gain(c: int) -> int:
            return len(missing & {d % period for x in cover for d in (c - x, x - c)})

        best = max((c for c in range(period) if c not in cover), key=gain)
        missing -= {d % period for x in cover for d in (best - x, x - best)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)


def cover_steps(distance: int) -> tuple[int, int]:
    """For a suffix that begins `distance` before its anchor, how far it is to the first sample
    place, and to the last one whose sample ends within the string.
    """
    marked = [d for d in range(LENGTH - SAMPLE + 1) if (d - distance) % PERIOD in COVER]
    return marked[0], marked[-1]


@dataclass
class Anchors:
    """Anchors of a slice, each with the run of suffixes it stands for."""

    hash: np.ndarray
    place: np.ndarray  # of the anchor, in the slice
    first: np.ndarray  # first and last suffix
    last: np.ndarray


def find_anchors(data: np.ndarray, bounds: np.ndarray, tables: ta.PowerTables) -> Anchors:
    """Anchors of all suffixes that have LENGTH bytes within their row."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Anchors(np.zeros(0, np.uint64), none, none, none)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = ta.range_hashes(data.astype(np.uint64), at, at + ANCHOR, tables)
    # The lowest hash of LENGTH - ANCHOR + 1 places; of equal ones the leftmost: the place is
    # kept in the low bits.
    low = hashes >> PLACE_BITS << PLACE_BITS | at.astype(np.uint64)
    step, reach = 1, LENGTH - ANCHOR + 1
    while step < reach:
        shift = min(step, reach - step)
        low = np.minimum(low[shift:], low[:-shift])
        step += shift
    place = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(data), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[a : max(a, b - LENGTH + 1)] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        return Anchors(np.zeros(0, np.uint64), none, none, none)
    of = place[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    # The hashes of anchors are the lowest of many; mixed again they spread over all buckets.
    return Anchors(ta.mix(hashes[of[fresh]] + np.uint64(1)), of[fresh], starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1])


def count_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, counts: the anchors that each task has counted, packed by bucket."""

    def flush(tally: Tally) -> pa.RecordBatch:
        keys, counts = tally.total()
        cuts = np.append(np.searchsorted(keys, bucket_starts(buckets)), len(keys))
        parts = [(b, *packed(keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        columns = list(zip(*parts, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, tally = ta.PowerTables(ta.BYTE_BASE), Tally(HELD)
        for whole in batches:
            for batch in ta.slices(whole, "text", SLICE_BYTES):
                keys = find_anchors(*ta.text_bytes(batch.column("text")), tables).hash
                tally.add(keys, np.ones(len(keys), np.int64))
                if tally.merged > HELD:
                    yield flush(tally)
                    tally = Tally(HELD)
        yield flush(tally)

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary")


REPEATED = pa.schema([("bucket", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, hash, n of every anchor that occurs more than once.

    A task sends each of its anchors once, so a very frequent one is no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally(HELD)

        def close() -> pa.RecordBatch:
            keys, counts = tally.total()
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(often.sum()), now, np.int32)), pa.array(keys[often].view(np.int64)), pa.array(counts[often])], schema=REPEATED
            )

        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield close()
                    now, tally = bucket, Tally(HELD)
                tally.add(*unpacked(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py()))
        if now is not None:
            yield close()

    counted = count_anchors(docs, buckets).repartition("bucket").sortWithinPartitions("bucket")
    return counted.mapInArrow(run, "bucket int, hash bigint, n bigint")


@dataclass
class Filter:
    """The repeated anchors as a Bloom filter, and the hot ones exactly."""

    buckets: int
    field: np.ndarray
    hot: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.field):
            return np.zeros(len(hashes), bool)
        return present(self.field, bucket_of(hashes, self.buckets), ta.mix(hashes), 1)


def build_filter(repeated: DataFrame, buckets: int, total: int, hot: np.ndarray) -> Filter:
    """Segments are filled where the anchors are; `total` entries of ENTRY_BITS bound the size."""
    bits = max(64, -(-total * ENTRY_BITS // buckets) // 64 * 64 + 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            for b in np.unique(bucket):
                field = fields.setdefault(int(b), np.zeros(bits // 8, np.uint8))
                for at in places(ta.mix(hashes[bucket == b]), 1, bits):
                    enter(field, at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(fields), pa.int32()), pa.array([f.tobytes() for f in fields.values()], pa.binary())], names=["bucket", "bits"]
        )

    field = np.zeros((buckets, bits // 8), np.uint8)
    for r in repeated.mapInArrow(run, "bucket int, bits binary").collect():
        field[r["bucket"]] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(buckets, field, np.sort(hot))


SEGMENT = "hash bigint, doc_id bigint, name bigint, place bigint, before int, after int, bytes binary"
SEGMENT_ROWS = pa.schema([
    ("hash", pa.int64()), ("doc_id", pa.int64()), ("name", pa.int64()), ("place", pa.int64()),
    ("before", pa.int32()), ("after", pa.int32()), ("bytes", pa.binary()),
])
NO_SEGMENTS = pa.RecordBatch.from_pylist([], schema=SEGMENT_ROWS)


def cut_segments(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
    """The text around the anchors for which `take(anchors, row, place, batch)` is true: its
    suffixes begin `before` .. `after` bytes before `place`.
    """
    tables = ta.PowerTables(ta.BYTE_BASE)
    for whole in batches:
        for batch in ta.slices(whole, "text", SLICE_BYTES):
            data, bounds = ta.text_bytes(batch.column("text"))
            found = find_anchors(data, bounds, tables)
            row = np.searchsorted(bounds, found.place, side="right") - 1
            chosen = np.flatnonzero(take(found, row, found.place - bounds[row], batch))
            if not len(chosen):
                continue
            place, first, last, r = found.place[chosen], found.first[chosen], found.last[chosen], row[chosen]
            text, at = data.tobytes(), pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.hash[chosen].view(np.int64)), batch.column("doc_id").take(at), batch.column("name").take(at),
                    pa.array(place - bounds[r]), pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32)),
                    pa.array([text[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                ],
                schema=SEGMENT_ROWS,
            )


def by_filter(known: Filter, hot: bool):
    """Chooses the anchors that may repeat: only the hot ones, or only the others."""

    def take(found: Anchors, row: np.ndarray, place: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        is_hot = np.isin(found.hash, known.hot)
        return is_hot if hot else known.passes(found.hash) & ~is_hot

    return take


def by_place(found: Anchors, row: np.ndarray, place: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Chooses the anchors at the places that the column `wanted` lists."""
    wanted = {(r, p) for r, ps in enumerate(batch.column("wanted").to_pylist()) for p in ps or ()}
    return np.array([k in wanted for k in zip(row.tolist(), place.tolist(), strict=True)], bool)


def segment_rows(docs: DataFrame, take) -> DataFrame:
    return docs.mapInArrow(lambda batches: cut_segments(batches, take), SEGMENT)


def segment_packs(docs: DataFrame, take, buckets: int) -> DataFrame:
    """bucket, pack: the segments of a bucket of anchors, many at a time and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for cut in cut_segments(batches, take):
            held.append(cut)
            n += cut.num_rows
            if n >= PACK_SEGMENTS:
                yield packs(held, buckets)
                held, n = [], 0
        yield packs(held or [NO_SEGMENTS], buckets)

    return docs.mapInArrow(run, "bucket int, pack binary")


def packs(held: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    bucket = bucket_of(rows["hash"].to_numpy().view(np.uint64), buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    compress = zstandard.ZstdCompressor(level=3).compress
    out = [(b, compress(to_ipc(rows.take(pa.array(order[i:j]))))) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "pack"]
    )


def to_ipc(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_ipc(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(pack)).read_all()


def suffix_names(hashes, before, after, blobs, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of the segments: its segment, its distance from the anchor, and a value
    that is equal for equal strings of one anchor and one distance.
    """
    sizes = np.array([len(b) for b in blobs])
    # Each text is laid so that its anchor is at a multiple of PERIOD.
    room = (sizes + 2 * PERIOD) // PERIOD * PERIOD + PERIOD
    base = np.cumsum(room) - room
    anchor = base + (before + PERIOD - 1) // PERIOD * PERIOD
    start = anchor - before
    data = np.zeros(int(room.sum()), np.uint64)
    joined = np.frombuffer(b"".join(blobs), np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data[np.repeat(start, sizes) + inner] = joined
    # Names of the samples: ranks of their bytes, which only equal bytes share.
    in_cover = np.zeros(PERIOD, bool)
    in_cover[COVER] = True
    marked = np.flatnonzero(in_cover[np.arange(len(data)) % PERIOD])
    marked = marked[marked + SAMPLE <= len(data)]
    _, rank = np.unique(ta.range_hashes(data, marked, marked + SAMPLE, tables), return_inverse=True)
    name = np.zeros(len(data), np.uint64)
    name[marked] = rank

    counts = before - after + 1
    of = np.repeat(np.arange(len(blobs)), counts)
    distance = np.repeat(before, counts) - (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    steps = np.array([cover_steps(d) for d in range(LENGTH)])
    at, (to_first, to_last) = anchor[of] - distance, steps[distance].T
    value = ta.mix(hashes[of] + distance.astype(np.uint64) * np.uint64(ta.WORD_BASE))
    for piece in (
        ta.range_hashes(data, at, at + to_first, tables),
        name[at + to_first],
        name[at + to_last],
        ta.range_hashes(data, at + to_last + SAMPLE, at + LENGTH, tables),
    ):
        value = ta.mix(value * np.uint64(ta.WORD_BASE) + piece)
    return of, distance, value


SPAN = "doc_id bigint, name bigint, start bigint, end bigint"
SPAN_ROWS = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def sort_bucket(rows: pa.Table, tables: ta.PowerTables) -> Iterator[pa.RecordBatch]:
    """Byte ranges of the segments' suffixes that also begin earlier. The rows are whole buckets,
    sorted by place; a null id comes first.
    """
    rows = rows.combine_chunks()
    hashes = rows["hash"].to_numpy().view(np.uint64)
    before, after = rows["before"].to_numpy().astype(np.int64), rows["after"].to_numpy().astype(np.int64)
    blobs = rows["bytes"].to_pylist()
    ids, names, place = rows["doc_id"].to_pylist(), rows["name"].to_numpy(), rows["place"].to_numpy()
    null, number = np.array([i is None for i in ids]), np.array([i or 0 for i in ids], np.int64)

    def same_place(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Segments of equal rows show the same place twice: none of them is earlier."""
        return (null[i] == null[j]) & (number[i] == number[j]) & (names[i] == names[j]) & (place[i] == place[j])

    # Equal segments: all suffixes of the later ones repeat; only the first is sorted.
    earliest: dict[tuple, int] = {}
    contents = zip(hashes.tolist(), before.tolist(), after.tolist(), blobs, strict=True)
    leader = np.array([earliest.setdefault(c, i) for i, c in enumerate(contents)])
    lead = np.flatnonzero(leader == np.arange(len(leader)))
    copy = np.flatnonzero((leader != np.arange(len(leader))) & ~same_place(leader, np.arange(len(leader))))

    of, distance, value = suffix_names(hashes[lead], before[lead], after[lead], [blobs[i] for i in lead], tables)
    of = lead[of]
    order = np.argsort(value, kind="stable")
    # In a run of equal strings all but those at the first place are repeated.
    fresh = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    own = of[order]
    first = own[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    repeated = np.zeros(len(of), bool)
    repeated[order] = ~fresh & ~same_place(first, own)
    hit = np.flatnonzero(repeated)
    # Suffixes of one segment that follow each other cover one range.
    new = np.concatenate([[True], (of[hit][1:] != of[hit][:-1]) | (hit[1:] != hit[:-1] + 1)]) if len(hit) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hit)) - 1 if len(begin) else begin
    seg = np.concatenate([of[hit[begin]], copy])
    if not len(seg):
        return
    start = np.concatenate([place[of[hit[begin]]] - distance[hit[begin]], place[copy] - before[copy]])
    stop = np.concatenate([place[of[hit[begin]]] - distance[hit[end]], place[copy] - after[copy]]) + LENGTH
    yield pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in seg], pa.int64()), pa.array(names[seg]), pa.array(start), pa.array(stop)],
        schema=SPAN_ROWS,
    )


def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over packs sorted by bucket: buckets one after the other, and in each a
    block of whole anchors at a time.
    """
    tables = ta.PowerTables(ta.BYTE_BASE)

    def close(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        order = [(c, "ascending") for c in ("hash", "doc_id", "name", "place")]
        rows = rows.take(pc.sort_indices(rows.select([c for c, _ in order]), sort_keys=order, null_placement="at_start"))
        hashes = rows["hash"].to_numpy()
        ends = np.append(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, len(hashes))  # of the anchors' rows
        at = 0
        while at < len(hashes):
            last = np.searchsorted(ends, at + BLOCK_SEGMENTS, side="right") - 1
            to = int(max(ends[max(last, 0)], ends[np.searchsorted(ends, at, side="right")]))
            yield from sort_bucket(rows.slice(at, to - at), tables)
            at = to

    now, held = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now and held:
                yield from close(held)
                held = []
            now = bucket
            held.append(from_ipc(batch.column("pack")[i].as_py()))
    if held:
        yield from close(held)


def hot_spans(hot_segments: DataFrame) -> DataFrame:
    """Ranges of the suffixes of hot anchors, one row per suffix.

    A hot bucket is too large for one task, so its suffixes are grouped by their names (128 bits
    of the whole string); first places are found by a partial aggregation, and the join back may
    be split where a name is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ta.PowerTables(ta.BYTE_BASE), ta.PowerTables(ta.WORD_BASE)
        for batch in batches:
            before, after = (batch.column(c).to_numpy().astype(np.int64) for c in ("before", "after"))
            counts = before - after + 1
            blobs = batch.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.uint64)
            sizes = np.array([len(b) for b in blobs])
            inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(np.cumsum(sizes) - sizes, counts) + inner
            seg = pa.array(np.repeat(np.arange(len(blobs)), counts))
            start = np.repeat(batch.column("place").to_numpy() - before, counts) + inner
            names = [ta.range_hashes(data, at, at + LENGTH, t).view(np.int64) for t in tables]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, names), batch.column("doc_id").take(seg), batch.column("name").take(seg), pa.array(start)],
                names=["a", "b", "doc_id", "name", "start"],
            )

    suffixes = hot_segments.mapInArrow(run, "a bigint, b bigint, doc_id bigint, name bigint, start bigint").distinct()
    place = F.struct("doc_id", "name", "start")
    first = suffixes.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = suffixes.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "name", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(
    spark: SparkSession, docs: DataFrame, hot_segments: int = HOT_SEGMENTS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, name, start, end: byte ranges covered by strings that also begin earlier.

    `docs` has doc_id, name (a hash of the text) and text.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-volume // BUCKET_BYTES))
    repeated = settle(repeated_anchors(docs, buckets), spark, "anchors")
    total, occurrences = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(hot_segments, occurrences // HOT_ANCHORS)
    # At most occurrences / limit anchors, so never more than HOT_ANCHORS unless a test asks for it.
    hot = np.array([r["hash"] for r in repeated.where(F.col("n") > limit).collect()], np.int64).view(np.uint64)
    parts = max(LEAST_BUCKETS, -(-occurrences // BUCKET_SEGMENTS))
    if total * ENTRY_BITS <= filter_bits:
        known = build_filter(repeated, buckets, total, hot)
        packed_segments = segment_packs(docs, by_filter(known, False), parts)
        busy = segment_rows(docs, by_filter(known, True))
    else:
        packed_segments = segment_packs(wanted_places(docs, repeated.where(F.col("n") <= limit)), by_place, parts)
        busy = segment_rows(wanted_places(docs, repeated.where(F.col("n") > limit)), by_place)
    spans = packed_segments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_buckets, SPAN)
    return spans.unionByName(hot_spans(busy)) if len(hot) else spans


def wanted_places(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The texts with `wanted`: the places of their repeated anchors, found by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ta.PowerTables(ta.BYTE_BASE)
        for whole in batches:
            for batch in ta.slices(whole, "text", SLICE_BYTES):
                data, bounds = ta.text_bytes(batch.column("text"))
                found = find_anchors(data, bounds, tables)
                row = np.searchsorted(bounds, found.place, side="right") - 1
                seg = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.hash.view(np.int64)), batch.column("doc_id").take(seg), batch.column("name").take(seg), pa.array(found.place - bounds[row])],
                    names=["hash", "w_id", "w_name", "place"],
                )

    anchors = docs.mapInArrow(run, "hash bigint, w_id bigint, w_name bigint, place bigint")
    found = anchors.join(repeated.select("hash"), "hash", "left_semi").groupBy("w_id", "w_name")
    wanted = found.agg(F.collect_set("place").alias("wanted"))
    same = docs["doc_id"].eqNullSafe(wanted["w_id"]) & (docs["name"] == wanted["w_name"])
    return docs.join(wanted, same).select("doc_id", "name", "text", "wanted")


RESULT = "doc_id bigint, text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(
    spark: SparkSession, docs: DataFrame, hot_segments: int = HOT_SEGMENTS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, text (what is left, undecodable ends of characters replaced), n_bytes, n_removed,
    n_spans and kept_sha256 for every row of `docs`.

    A byte goes if it lies in a LENGTH-byte string of its text that also starts earlier: in a
    document of smaller id (null first), or earlier in its own. Documents of one id are ordered
    by a hash of their texts; rows equal in id and text are one document, each with its result.
    A null text is empty; nothing is removed from texts shorter than LENGTH bytes. Only doc_id
    and text are read.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = narrow.withColumn("name", F.xxhash64("text"))
    spans = settle(repeated_spans(spark, named.select("doc_id", "name", "text"), hot_segments, filter_bits), spark, "spans")
    per_doc = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("name").alias("s_name")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    )
    joined = named.join(per_doc, named["doc_id"].eqNullSafe(per_doc["s_id"]) & (named["name"] == per_doc["s_name"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ta.slices(whole, "text", SLICE_BYTES):
                rows = []
                for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                    raw = text.as_py().encode()
                    kept, n_spans = without(raw, spans.as_py() or [])
                    rows.append((doc.as_py(), kept.decode(errors="replace"), len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def without(raw: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs that went."""
    kept, at, runs = [], 0, 0
    reach = -1
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] > reach:
            runs += 1
            kept.append(raw[at : s["start"]])
        reach = max(reach, s["end"])
        at = reach
    return b"".join([*kept, raw[at:]]), runs
