"""Language-model scores from a log-frequency Bloom filter.

All unigrams and bigrams of the training texts are counted. A gram of quantised count q, the
logarithm of its count, is entered in a Bloom filter as (gram, 1) .. (gram, q); a reader probes
(gram, 1), (gram, 2), ... until one is missing and so learns q. Bigram and unigram estimates
are interpolated.

Counts are gathered in buckets of the gram's hash. Each bucket owns one segment of the filter
and fills it where the counts are, so the counts never meet in one place. A segment is as large
as its grams need at the intended error rate, so the filter grows with the corpus and holds
every gram. It is broadcast to the workers in spans, runs of segments of a bounded size, one
after the other: texts are written as chunks of tokens, whose distinct grams are stored by span;
a span's grams are probed while it is with the workers, then it is withdrawn. Unigram counts for
the base score are exact and complete: the frequent ones travel, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta
from visitbook.llm.hash_buckets import Tally, add_up, bucket_of, bucket_starts, enter, packed, places, present, unpacked
from visitbook.session import remove_folder, scratch_dir, settle

# Bytes of text gathered into one bucket.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 16
# Bits of the filter for each entry: about 2 % false hits.
ENTRY_BITS = 8
# Bytes of the filter that are broadcast at a time, or one segment. A cluster gives what its
# workers can hold: the grams of a task are written to as many files as there are spans.
SPAN_BYTES = 16 << 20
# Tokens of a chunk, or one text.
CHUNK_TOKENS = 1 << 19
# Keys that a task gathers of each kind before it hands them on.
HELD_GRAMS = 1 << 20
# Size of a row group of chunks, whose values are large.
GROUP_BYTES = 16 << 20
# Tokens whose exact counts travel with the task.
FREQUENT_TOKENS = 1 << 18
WEIGHTS = np.concatenate([[0.0], np.geomspace(0.001, 0.9, 19)])
LEVELS = 48

END = np.uint64(0x5851F42D4C957F2D)  # the token that closes a text, and opens the next
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def token_hashes(column: pa.Array, tables: ta.PowerTables) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the rows, each row closed by END, and the row bounds."""
    data, bounds = ta.text_bytes(column)
    starts, ends, first = ta.token_bounds(SPACES[data], bounds)
    words = ta.range_hashes(LOWER[data].astype(np.uint64), starts, ends, tables)
    rows = np.arange(len(bounds))
    tokens = np.full(len(words) + len(bounds) - 1, END, np.uint64)
    row_of_word = np.repeat(rows[:-1], np.diff(first))
    tokens[np.arange(len(words)) + row_of_word] = words
    return tokens, first + rows


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """Per token the hash of it and its predecessor; a text's first token follows END."""
    before = np.concatenate([[END], tokens[:-1]])
    return ta.mix(before * np.uint64(ta.WORD_BASE) + tokens)


UNIGRAM, BIGRAM = 1, 2
GRAM_SHIFT = np.uint64(16)  # bigrams are told apart by 48 bits


def gram_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, kind, keys, counts: what each task has counted, packed by bucket."""

    def flush(kind: int, tally: Tally) -> Iterator[tuple]:
        keys, counts = tally.total()
        cuts = np.searchsorted(keys, np.append(bucket_starts(buckets), np.uint64(0xFFFFFFFFFFFFFFFF)))
        cuts[-1] = len(keys)
        for b in range(buckets):
            part, n = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
            for light in (n < 256, n >= 256):  # a few large counts do not widen all
                if light.any():
                    mine = part[light] if kind == UNIGRAM else part[light] >> GRAM_SHIFT
                    yield (b, kind, *packed(mine, n[light]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, one, two = ta.PowerTables(ta.BYTE_BASE), Tally(HELD_GRAMS), Tally(HELD_GRAMS)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                tokens, _ = token_hashes(batch.column("text"), tables)
                for tally, keys in ((one, tokens), (two, bigrams(tokens))):
                    tally.add(*add_up(keys, np.ones(len(keys), np.int64)))
                if two.merged > HELD_GRAMS:
                    yield packed_rows([*flush(UNIGRAM, one), *flush(BIGRAM, two)])
                    one, two = Tally(HELD_GRAMS), Tally(HELD_GRAMS)
        yield packed_rows([*flush(UNIGRAM, one), *flush(BIGRAM, two)])

    return texts.select("text").mapInArrow(run, "bucket int, kind int, keys binary, counts binary")


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "kind", "keys", "counts"]
    )


def gram_ids(keys: np.ndarray, kind: int) -> np.ndarray:
    """What is entered and probed for a gram; unigrams and bigrams never meet."""
    return ta.mix(keys * np.uint64(2 * kind + 1))


def levels_of(counts: np.ndarray, cutoff: int) -> np.ndarray:
    """Quantised counts: 0 below the cutoff, then one more for each doubling of it."""
    return np.where(counts >= cutoff, np.log2(np.maximum(counts, 1) / cutoff + 1e-12).astype(np.int64) + 1, 0)


def smallest_cutoff(counts: np.ndarray, room: int) -> int:
    """The least cutoff at which the entries of these counts fit."""
    cutoff = 1
    while levels_of(counts, cutoff).sum() > room:
        cutoff += max(1, cutoff // 4)
    return cutoff


def needed_bits(unigrams: np.ndarray, bigram_counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> int:
    """The least segment in which all grams of these counts fit."""
    one, two = int(levels_of(unigrams, 1).sum()), int(levels_of(bigram_counts, 1).sum())
    return max(64, -(-entry_bits * max(2 * one, one + two) // 64) * 64)


def segment(unigrams: tuple, bigram_counts: tuple, bits: int, entry_bits: int = ENTRY_BITS) -> tuple[bytes, int, int]:
    """One bucket's part of the filter, and the cutoffs of unigrams and bigrams."""
    room = bits // entry_bits
    field = np.zeros(bits // 8, np.uint8)
    cut_1 = smallest_cutoff(unigrams[1], room // 2)
    cut_2 = smallest_cutoff(bigram_counts[1], room - int(levels_of(unigrams[1], cut_1).sum()))
    for kind, cutoff, (keys, counts) in ((UNIGRAM, cut_1, unigrams), (BIGRAM, cut_2, bigram_counts)):
        ids, levels = gram_ids(keys, kind), levels_of(counts, cutoff)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in places(ids[levels >= level], level, bits):
                enter(field, at)
    return field.tobytes(), cut_1, cut_2


# kind: STATS has one row a bucket; FREQUENT and RARE have one row a token.
STATS, FREQUENT, RARE = 0, 1, 2
BUCKET_ROWS = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()),
    ("cut_1", pa.int64()), ("cut_2", pa.int64()),
])
BUCKET_SCHEMA = "kind int, bucket int, key bigint, n bigint, bits binary, cut_1 bigint, cut_2 bigint"


def merge_buckets(most_bits: int | None, frequent: int, entry_bits: int):
    """Task function over rows sorted by bucket: its totals, filter segment and token counts."""

    def close(bucket: int, tallies: dict[int, Tally]) -> Iterator[pa.RecordBatch]:
        (keys, counts), two = tallies[UNIGRAM].total(), tallies[BIGRAM].total()
        bits = needed_bits(counts, two[1], entry_bits)
        bits = bits if most_bits is None else min(bits, most_bits)
        field, cut_1, cut_2 = segment((keys >> GRAM_SHIFT, counts), two, bits, entry_bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((STATS, bucket, len(keys), int(counts.sum()), field, cut_1, cut_2), BUCKET_ROWS, strict=True)],
            schema=BUCKET_ROWS,
        )
        kind = np.full(len(keys), RARE, np.int32)
        kind[np.argsort(-counts, kind="stable")[:frequent]] = FREQUENT
        blank = [pa.nulls(len(keys), t) for t in (pa.binary(), pa.int64(), pa.int64())]
        columns = [pa.array(kind), pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays([*columns, *blank], schema=BUCKET_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tallies = None, {}
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield from close(now, tallies)
                    now, tallies = bucket, {UNIGRAM: Tally(HELD_GRAMS), BIGRAM: Tally(HELD_GRAMS)}
                part = unpacked(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py())
                tallies[batch.column("kind")[i].as_py()].add(*part)
        if now is not None:
            yield from close(now, tallies)

    return run


def remaining(estimates: np.ndarray, left_out: np.ndarray | int) -> np.ndarray:
    """Estimates without so many occurrences; nothing if these alone explain the level."""
    least = (estimates + 0.5) / 1.5  # of the level, whose middle the estimate is
    return np.where(left_out >= least - 1e-9, 0.0, np.maximum(estimates - left_out, 0))


@dataclass
class Model:
    """What a worker needs: one segment of the filter, or none; at most FREQUENT_TOKENS counts."""

    buckets: int
    bits: int  # of each segment
    field: np.ndarray  # [bucket, byte]
    cutoffs: np.ndarray  # [bucket, kind - 1]
    tokens: int  # N
    distinct: int  # V
    keys: np.ndarray  # frequent tokens, ascending
    counts: np.ndarray

    def levels(self, keys: np.ndarray, kind: int, at_most: np.ndarray) -> np.ndarray:
        """Quantised counts of grams by repeated probes, up to a level known from their parts."""
        found = np.zeros(len(keys), np.int64)
        if not len(self.field):
            return found
        bucket = bucket_of(keys, self.buckets)
        ids = gram_ids(keys >> GRAM_SHIFT, kind)
        alive = np.flatnonzero(at_most > 0)
        level = 1
        while len(alive):
            alive = alive[present(self.field, bucket[alive], ids[alive], level)]
            found[alive] = level
            level += 1
            alive = alive[at_most[alive] >= level]
        return found

    def estimates(self, keys: np.ndarray, kind: int, levels: np.ndarray) -> np.ndarray:
        """Expected counts of the levels: the middle of what a level stands for, 0 for level 0."""
        cutoff = self.cutoffs[bucket_of(keys, self.buckets), kind - 1] if len(self.cutoffs) else np.ones(len(keys))
        low = cutoff * 2.0 ** (levels - 1)
        return np.where(levels > 0, (low + np.maximum(2 * low - 1, low)) / 2, 0.0)

    def parts(self, read: Chunk, leave_out: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token the unigram and bigram estimates and the level of its context.

        With `leave_out`, each token's text has so many copies, which are taken out of the counts.
        """
        count = self.estimates(read.keys, UNIGRAM, read.one)[read.index]
        level = read.one[read.index]
        end = int(np.searchsorted(read.keys, END))
        first = read.one[end], self.estimates(read.keys[end : end + 1], UNIGRAM, read.one[end : end + 1])[0]
        before_level, before = np.concatenate([[first[0]], level[:-1]]), np.concatenate([[first[1]], count[:-1]])
        # A pair is not more frequent than its tokens; one level is left for the middles of levels.
        most = np.minimum(np.minimum(before_level, level) + 1, LEVELS - 1) * (before_level > 0)
        pair = np.minimum(self.estimates(bigrams(read.keys[read.index]), BIGRAM, np.minimum(read.pair, most)), before)
        p1 = (remaining(count, leave_out) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        p2 = remaining(pair, leave_out) / np.maximum(remaining(before, leave_out), 1)
        return np.minimum(p1, 1.0), np.minimum(p2, 1.0), before_level

    def log10(self, read: Chunk, weights: np.ndarray) -> np.ndarray:
        """Per token the log10 of the interpolated probability; the bigram's weight depends on
        the level of its context.
        """
        p1, p2, level = self.parts(read)
        weight = weights[np.minimum(level, LEVELS - 1)]
        return np.log10(weight * p2 + (1 - weight) * p1)


@dataclass
class Chunk:
    """Tokens of some texts, and what the filter holds of them."""

    rows: pa.StructArray  # row, doc_id, copies, n_tokens of each text
    keys: np.ndarray  # distinct tokens, ascending
    index: np.ndarray  # of each token, in the keys
    one: np.ndarray  # level of each key
    pair: np.ndarray  # level of each token with its predecessor

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.asarray(self.rows.field("n_tokens")))])


ROW = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64())])
TEXT_ROWS = "rows array<struct<row: bigint, doc_id: bigint, copies: bigint, n_tokens: bigint>>"


def squeezed(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then the next ones, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 3)


def restored(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def chunk_tokens(keys: pa.BinaryScalar, tokens: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a chunk in order, and the index of each token in them."""
    held = np.frombuffer(keys.as_py(), np.uint64)
    order = np.argsort(held)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return held[order], place[restored(tokens.as_py(), np.uint32)]


def chunked(texts: DataFrame) -> DataFrame:
    """chunk, rows, keys, tokens: the texts (row, doc_id, copies, text) in chunks of tokens."""

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        keys, index, counts = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent tokens take less room
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        rows = pa.concat_arrays([h[1] for h in held])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[0]["row"].as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([keys[order].tobytes()], pa.binary()), pa.array([squeezed(rank[index])], pa.binary()),
            ],
            names=["chunk", "rows", "keys", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = ta.PowerTables(ta.BYTE_BASE), [], 0
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                tokens, bounds = token_hashes(batch.column("text"), tables)
                columns = [*(batch.column(f.name) for f in list(ROW)[:-1]), pa.array(np.diff(bounds), pa.int64())]
                held.append((tokens, pa.StructArray.from_arrays(columns, fields=list(ROW))))
                size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return texts.mapInArrow(run, f"chunk bigint, {TEXT_ROWS}, keys binary, tokens binary")


ASKED = "span int, chunk bigint, kind int, sizes binary, steps binary"


def requests(chunks: DataFrame, buckets: int, per_span: int) -> DataFrame:
    """The distinct grams of every chunk in order, by spans of `per_span` buckets: how many there
    are in each bucket of the span, and the steps from one gram to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bucket_starts(buckets)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, index = chunk_tokens(batch.column("keys")[i], batch.column("tokens")[i])
                out: list[tuple] = []
                for kind, grams in ((UNIGRAM, keys), (BIGRAM, np.unique(bigrams(keys[index])))):
                    cuts = np.append(np.searchsorted(grams, starts), len(grams))
                    for span, first in enumerate(range(0, buckets, per_span)):
                        mine = cuts[first : first + per_span + 1]
                        part = grams[mine[0] : mine[-1]] >> GRAM_SHIFT
                        if len(part):
                            sizes = np.diff(mine).astype(np.int64).tobytes()
                            out.append((span, kind, sizes, squeezed(np.diff(part, prepend=np.uint64(0)))))
                spans, kinds, sizes, steps = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spans, pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(out), pa.int64()),
                        pa.array(kinds, pa.int32()), pa.array(sizes, pa.binary()), pa.array(steps, pa.binary()),
                    ],
                    names=["span", "chunk", "kind", "sizes", "steps"],
                )

    return chunks.select("chunk", "keys", "tokens").mapInArrow(run, ASKED)


ANSWERED = "chunk bigint, span int, kind int, levels binary"


def answers(asked: DataFrame, shared: Broadcast[list[tuple[int, bytes]]], first: int) -> DataFrame:
    """What the segments with the workers, those from bucket `first` on, hold of a span's grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0)
        models = {
            bucket: Model(1, len(bits) * 8, np.frombuffer(bits, np.uint8)[None, :], np.ones((1, 2)), 0, 0, none, none)
            for bucket, bits in shared.value
        }
        for batch in batches:
            held = []
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                keys = np.cumsum(restored(batch.column("steps")[i].as_py(), np.uint64), dtype=np.uint64) << GRAM_SHIFT
                ends = np.cumsum(np.frombuffer(batch.column("sizes")[i].as_py(), np.int64))
                levels = np.zeros(len(keys), np.uint8)
                for bucket, start, end in zip(range(first, first + len(ends)), [0, *ends[:-1]], ends, strict=True):
                    if bucket in models and start < end:
                        most = np.full(end - start, LEVELS - 1)
                        levels[start:end] = models[bucket].levels(keys[start:end], kind, most)
                held.append(zstandard.compress(levels.tobytes(), 3))
            if held:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("chunk", "span", "kind")), pa.array(held, pa.binary())],
                    names=["chunk", "span", "kind", "levels"],
                )

    return asked.mapInArrow(run, ANSWERED)


def probe(spark: SparkSession, chunks: DataFrame, segments: DataFrame, buckets: int, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The answers to all grams of the chunks: each span of the filter is broadcast, probed and
    withdrawn. Driver and workers hold one span at a time.
    """
    largest = segments.agg(F.max(F.octet_length("bits"))).first()[0] or 1
    per_span = min(buckets, max(1, span_bytes // largest))
    asked, found = scratch_dir(spark, "asked"), scratch_dir(spark, "answers")
    requests(chunks, buckets, per_span).write.partitionBy("span").parquet(asked)
    stored = spark.read.schema(ASKED).parquet(asked)
    spans = range(-(-buckets // per_span))
    for span in spans:
        first = span * per_span
        bits = segments.where(F.col("bucket").between(first, first + per_span - 1)).collect()
        shared = spark.sparkContext.broadcast([(r["bucket"], bytes(r["bits"])) for r in bits])
        answers(stored.where(F.col("span") == span), shared, first).write.parquet(f"{found}/{span}")
        shared.destroy()
    remove_folder(spark, asked)
    return spark.read.schema(ANSWERED).parquet(*(f"{found}/{span}" for span in spans))


READ = f"{TEXT_ROWS}, keys binary, tokens binary, one binary, pair binary"


def with_levels(chunks: DataFrame, answered: DataFrame) -> DataFrame:
    """rows, keys, tokens, one, pair: the chunks, and the levels of their grams."""

    def joined(parts: list[bytes]) -> bytes:
        return b"".join(zstandard.decompress(p) for p in parts)

    def close(held: dict, levels: dict[int, list[bytes]]) -> pa.RecordBatch:
        keys, index = chunk_tokens(held["keys"][0], held["tokens"][0])
        _, inverse = np.unique(bigrams(keys[index]), return_inverse=True)
        pair = np.frombuffer(joined(levels[BIGRAM]), np.uint8)[inverse]
        return pa.RecordBatch.from_arrays(
            [*held.values(), pa.array([joined(levels[UNIGRAM])], pa.binary()), pa.array([squeezed(pair)], pa.binary())],
            names=["rows", "keys", "tokens", "one", "pair"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        levels: dict[int, list[bytes]] = {}
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind is None:  # a chunk comes before its levels, and these by span
                    if held:
                        yield close(held, levels)
                    held, levels = {c: batch.column(c).slice(i, 1) for c in ("rows", "keys", "tokens")}, {UNIGRAM: [], BIGRAM: []}
                    held = {c: pa.concat_arrays([a]) for c, a in held.items()}
                else:
                    levels[kind].append(batch.column("levels")[i].as_py())
        if held:
            yield close(held, levels)

    asked = chunks.withColumns({
        "span": F.lit(-1), "kind": F.lit(None).cast("int"), "levels": F.lit(None).cast("binary"),
    })
    met = asked.unionByName(answered, allowMissingColumns=True).repartition("chunk")
    return met.sortWithinPartitions("chunk", "span", "kind").mapInArrow(run, READ)


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys, index = chunk_tokens(batch.column("keys")[i], batch.column("tokens")[i])
            one = np.frombuffer(batch.column("one")[i].as_py(), np.uint8).astype(np.int64)
            pair = restored(batch.column("pair")[i].as_py(), np.uint8).astype(np.int64)
            yield Chunk(batch.column("rows")[i].values, keys, index, one, pair)


def train(
    spark: SparkSession, texts: DataFrame, max_filter_bits: int | None = None, frequent_tokens: int = FREQUENT_TOKENS,
    entry_bits: int = ENTRY_BITS,
) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the texts without its filter; the filter's segments (bucket, bits); and key, n
    of every token that is not among the frequent ones.

    Every text is counted. Null texts are empty; an empty text teaches its END. Unless the caller
    bounds the filter, every gram is in it.
    """
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-volume // BUCKET_BYTES))
    most_bits = None if max_filter_bits is None else max(64, max_filter_bits // buckets // 64 * 64)
    counted = gram_counts(texts, buckets).repartition("bucket").sortWithinPartitions("bucket", "kind")
    per_bucket = counted.mapInArrow(merge_buckets(most_bits, max(1, frequent_tokens // buckets), entry_bits), BUCKET_SCHEMA)
    stored = settle(per_bucket, spark, "grams")
    cutoffs = np.ones((buckets, 2), np.int64)
    tokens = distinct = 0
    for r in stored.where(F.col("kind") == STATS).drop("bits").collect():  # a row a bucket
        cutoffs[r["bucket"]] = r["cut_1"], r["cut_2"]
        tokens, distinct = tokens + r["n"], distinct + r["key"]
    frequent = stored.where(F.col("kind") == FREQUENT).select("key", "n").toPandas()  # at most frequent_tokens
    keys = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(
        buckets, 0, np.zeros((0, 0), np.uint8), cutoffs, tokens, distinct,
        keys[order], frequent["n"].to_numpy(np.int64)[order],
    )
    segments = settle(stored.where(F.col("kind") == STATS).select("bucket", "bits"), spark, "segments")
    return model, segments, stored.where(F.col("kind") == RARE).select("key", "n")


def fit_weights(shared: Broadcast[Model], read: DataFrame) -> np.ndarray:
    """For each level of the context the weight that makes the texts with copies, which were
    counted, most likely when each occurrence is left out of its own counts. A text of n copies
    counts as one nth, without the counts of all n. Only sums per level and weight reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, np.zeros((LEVELS, len(WEIGHTS)))
        for chunk in read_chunks(batches):
            copies = np.repeat(np.asarray(chunk.rows.field("copies")), np.asarray(chunk.rows.field("n_tokens")))
            fitted = np.flatnonzero(copies)
            if len(fitted):
                p1, p2, level = (x[fitted] for x in model.parts(chunk, leave_out=copies))
                for k, w in enumerate(WEIGHTS):
                    sums[:, k] += np.bincount(level, np.log(w * p2 + (1 - w) * p1) / copies[fitted], LEVELS)[:LEVELS]
        at = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(sums.ravel())], names=["level", "weight", "gain"]
        )

    rows = read.mapInArrow(run, "level bigint, weight bigint, gain double")
    total = np.zeros((LEVELS, len(WEIGHTS)))
    for r in rows.groupBy("level", "weight").agg(F.sum("gain").alias("gain")).collect():
        total[r["level"], r["weight"]] = r["gain"]
    return WEIGHTS[np.argmax(total, axis=1)]


SCANNED = (
    "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, score double, "
    "rare array<struct<key: bigint, n: bigint>>"
)


def scan(read: DataFrame, shared: Broadcast[Model], weights: np.ndarray) -> DataFrame:
    """Per row the model's score, the base score's sum over frequent tokens, and its other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for chunk in read_chunks(batches):
            tokens, bounds, n_rows = chunk.keys[chunk.index], chunk.bounds(), len(chunk.rows)
            score = np.add.reduceat(model.log10(chunk, weights), bounds[:-1])
            at = np.minimum(np.searchsorted(model.keys, tokens), max(0, len(model.keys) - 1))
            frequent = model.keys[at] == tokens if len(model.keys) else np.zeros(len(tokens), bool)
            count = np.where(frequent, model.counts[at] if len(model.keys) else 0, 0)
            base = np.add.reduceat(np.where(frequent, np.log10(count + 0.5), 0.0), bounds[:-1])
            row = np.repeat(np.arange(n_rows), np.diff(bounds))[~frequent]
            keys = tokens[~frequent]
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])]) if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            pairs = pa.StructArray.from_arrays(
                [pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(row))).astype(np.int64))], names=["key", "n"]
            )
            offsets = np.searchsorted(row[first], np.arange(n_rows + 1)).astype(np.int32)
            known = np.add.reduceat(frequent.astype(np.int64), bounds[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.field("row"), chunk.rows.field("doc_id"), pa.array(np.diff(bounds)), pa.array(known),
                    pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), pairs),
                ],
                names=["row", "doc_id", "n_tokens", "known", "base", "score", "rare"],
            )

    return read.mapInArrow(run, SCANNED)


def score_documents(
    spark: SparkSession, docs: DataFrame, held_out: Column, max_filter_bits: int | None = None,
    frequent_tokens: int = FREQUENT_TOKENS, entry_bits: int = ENTRY_BITS, span_bytes: int = SPAN_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    The rows for which `held_out` is not true are learned from, and the interpolation weights are
    fitted on all of them, equal texts counted once. `base_score` uses exact counts
    (tokens are told apart by 64-bit hashes); `score` is the interpolated model's log10
    probability of the text. A null or empty text has the closing token only; equal rows count
    and are scored one by one. Without training rows every token is unknown. Each entry has
    `entry_bits` bits of the filter, of which `span_bytes` are broadcast at a time.
    """
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    learned = narrow.where("NOT held_out")
    model, segments, rare_counts = train(spark, learned.select("text"), max_filter_bits, frequent_tokens, entry_bits)
    # Equal texts by 128 bits. Only those that repeat are settled, so a small list is broadcast.
    text = F.coalesce("text", F.lit(""))
    same = [F.xxhash64(text).alias("same_1"), F.xxhash64(F.lit("again"), text).alias("same_2")]
    repeated = learned.select(*same).groupBy("same_1", "same_2").agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = settle(repeated, spark, "copies")
    copies = F.when(F.col("held_out"), 0).otherwise(F.coalesce("copies", F.lit(1))).cast("bigint").alias("copies")
    numbered = narrow.select("*", *same).join(repeated, ["same_1", "same_2"], "left").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", copies, "text"
    )
    folder = scratch_dir(spark, "chunks")
    made = chunked(numbered)
    made.write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    chunks = spark.read.schema(made.schema).parquet(folder)
    answered = probe(spark, chunks, segments, model.buckets, span_bytes)
    levels, joined = scratch_dir(spark, "levels"), with_levels(chunks, answered)
    joined.write.option("parquet.block.size", GROUP_BYTES).parquet(levels)
    read = spark.read.schema(joined.schema).parquet(levels)
    remove_folder(spark, folder)  # all it holds is in `read`
    shared = spark.sparkContext.broadcast(model)
    weights = fit_weights(shared, read)
    scanned = settle(scan(read, shared, weights), spark, "scores")
    shared.destroy()
    others = scanned.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    looked_up = others.join(rare_counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    each = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    whole = scanned.drop("rare").join(looked_up, "row", "left")
    return whole.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )
