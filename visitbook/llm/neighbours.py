"""Nearest neighbours by collision counting.

Each of M random projections keeps the vectors in a sorted array. Around a query's projection a
window of the width W * radius is opened in every array; a vector that lies in the windows of
enough projections is verified by its distance. Virtual rehashing widens the same windows as
the radius grows, until the K-th best distance is within the radius.

The index is kept in blocks of bounded size, into which the vectors are shuffled once. Queries
are broadcast in slices of a bounded number, one after the other; every block answers every
slice, and the answers of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitbook.session import scratch_dir, settle

NEIGHBOURS = 10
PROJECTIONS = 384
# Width of a window in radii, and growth of the radius from one rehashing to the next.
WIDTH, GROWTH = 2.72, 1.06
# Standard deviations below the mean number of collisions of a vector at the radius.
CAUTION = 2.5
BLOCK_VECTORS = 8192
# Vectors of a block by which the first radius is chosen.
PART_VECTORS = 512
# Queries that are broadcast at a time.
BLOCK_QUERIES = 4096
# Files the blocks are written to, at most.
BLOCK_FILES = 10_000
SEED = 20

FOUND = "query_id bigint, vec_id bigint, score double"
BLOCKS = "length int, ids binary, vectors binary"


def collision_threshold(projections: int = PROJECTIONS, width: float = WIDTH, caution: float = CAUTION) -> int:
    """Collisions that a vector at the radius is likely to reach; nearer ones reach more.

    The difference of two projections is normal with the distance as its deviation, so at the
    radius a projection collides with the chance that a normal value is within width / 2.
    """
    p = erf(width / 2 / sqrt(2))
    return max(1, int(projections * p - caution * sqrt(projections * p * (1 - p))))


class SortedProjections:
    """The index of one block: for each projection the vectors' numbers in sorted order."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED, projections: int = PROJECTIONS):
        self.vectors = vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        projected = (vectors @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.order = order
        # The place of each vector in each sorted array.
        self.place = np.empty(order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=self.place.dtype)[None, :], axis=1)
        # All arrays end to end, each moved beyond the one before, so that one search serves all.
        low, high = projected.min(axis=1), projected.max(axis=1)
        self.low, self.high = low, high
        self.shift = np.concatenate([[0.0], np.cumsum(high - low + 1.0)[:-1]]) - low
        self.line = (np.take_along_axis(projected, order, axis=1) + self.shift[:, None]).ravel()
        self.first = np.arange(projections) * len(vectors)
        self.threshold = collision_threshold(projections)
        self.part = np.random.default_rng(seed + 1).permutation(len(vectors))[:PART_VECTORS]

    def reach(self, at: np.ndarray, side: str) -> np.ndarray:
        """For each projection the place in its sorted array of a projected value."""
        inside = np.clip(at, self.low, self.high) + self.shift
        found = np.searchsorted(self.line, inside, side) - self.first
        n = len(self.vectors)
        return np.where(at < self.low, 0, np.where(at > self.high, n, np.clip(found, 0, n)))

    def counts_within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the number of windows [low, high) that hold it."""
        kind = self.place.dtype
        # A place before the window wraps round to a large number.
        inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        counts = np.zeros(len(self.vectors), np.int64)
        for a in range(0, len(inside), 255):  # sums that fit a byte
            counts += np.add.reduce(inside[a : a + 255].view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def first_radius(self, query: np.ndarray, skip: int | None, wanted: int) -> float:
        """Somewhat less than the distance within which a random part of the block holds its share
        of the wanted vectors, or one: few vectors of the block are nearer, however they lie.
        """
        part = self.part[self.part != skip] if skip is not None else self.part
        distances = np.sqrt(((self.vectors[part] - query) ** 2).sum(axis=1))
        rank = max(1, wanted * len(part) // len(self.vectors)) - 1
        return 0.85 * float(np.partition(distances, rank)[rank])

    def search(self, query: np.ndarray, skip: int | None, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and distances of the verified vectors that may be among the nearest, and how
        many were verified.

        All vectors as near as the last one wanted are returned, so that ties can be told apart
        afterwards. `skip` is the query's own number in this block.
        """
        n = len(self.vectors)
        wanted = min(neighbours, n - (skip is not None))
        if wanted <= 0:
            return np.zeros(0, np.int64), np.zeros(0), 0
        centre = query @ self.directions
        collisions = None
        verified = np.zeros(n, bool)
        if skip is not None:
            verified[skip] = True
        numbers, distances = np.zeros(0, np.int64), np.zeros(0)
        left = self.reach(centre, "left")
        right, radius = left.copy(), self.first_radius(query, skip, wanted)
        everything = False
        while True:
            half = radius * WIDTH / 2
            low = np.minimum(self.reach(centre - half, "left"), left)
            high = np.maximum(self.reach(centre + half, "right"), right)
            if collisions is None:
                collisions = self.counts_within(low, high)
            else:  # the windows grow; only what is new is counted
                new = [o[a:b] for o, a, b in zip(self.order, low.tolist(), left.tolist(), strict=True)]
                new += [o[a:b] for o, a, b in zip(self.order, right.tolist(), high.tolist(), strict=True)]
                collisions += np.bincount(np.concatenate(new), minlength=n)
            left, right = low, high
            fresh = np.flatnonzero((collisions >= self.threshold) & ~verified)
            if everything:
                fresh = np.flatnonzero(~verified)
            verified[fresh] = True
            numbers = np.concatenate([numbers, fresh])
            distances = np.concatenate([distances, np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))])
            if len(numbers) >= wanted:
                last = np.partition(distances, wanted - 1)[wanted - 1]
                if last <= radius or everything:
                    near = distances <= last
                    return numbers[near], distances[near], len(numbers)
            # A radius of 0 (many equal vectors) cannot grow by a factor.
            everything = (right - left == n).all()
            radius = radius * GROWTH if radius > 0 else self._smallest_step(centre, left, right)

    def _smallest_step(self, centre: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
        n = len(self.vectors)
        sorted_rows = self.line.reshape(-1, n) - self.shift[:, None]
        steps = [
            min([abs(row[k] - c) for k in (a - 1, b) if 0 <= k < n], default=0.0)
            for row, c, a, b in zip(sorted_rows, centre, left, right, strict=True)
        ]
        return 2 * max(float(np.median(steps)), 1e-9) / WIDTH


def usable(embedding: Column) -> Column:
    """Vectors that are not null, not empty, not zero and hold finite numbers only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["embedding"].tolist(), dtype=np.float64).reshape(len(frame), -1)


def pack(vectors: pd.DataFrame) -> pd.DataFrame:
    """Group function: one block as a row."""
    vectors = vectors.sort_values("vec_id")
    data = stacked(vectors)
    row = {"length": [data.shape[1]], "ids": [vectors["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [data.tobytes()]}
    return pd.DataFrame(row)


def answer(shared: Broadcast[dict[int, tuple[np.ndarray, np.ndarray]]], neighbours: int):
    """Task function: the answers of blocks of vectors to the queries of their length."""

    def of_block(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = SortedProjections(vectors)
        for query_id, query in zip(asked, queries, strict=True):
            own = np.flatnonzero(ids == query_id)
            numbers, distances, _ = index.search(query, int(own[0]) if len(own) else None, neighbours)
            order = np.lexsort((ids[numbers], distances))[:neighbours]
            yield np.full(len(order), query_id), ids[numbers][order], distances[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, length in enumerate(batch.column("length").to_pylist()):
                if length in shared.value:
                    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    vectors = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(len(ids), length)
                    found = [np.concatenate(c) for c in zip(*of_block(ids, vectors, *shared.value[length]), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def by_length(queries: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {n: (q["vec_id"].to_numpy(np.int64), stacked(q)) for n, q in queries.groupby("length")}


def nearest(
    spark: SparkSession, vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS,
    block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest `neighbours` found for each query.

    Nearness is the Euclidean distance in double precision; ties go to the smaller vec_id. A
    query's candidates are all usable vectors of its length but its own. Unusable vectors (see
    `usable`), and vectors without an id, neither ask nor answer. Rows that repeat an id and
    its vector count once; of different vectors under one id the first in order counts. Blocks
    are dealt by a hash of the id, so equal vectors spread evenly. Driver and workers hold one
    slice of about `block_queries` queries at a time.
    """
    given = vectors.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)  # exact in double precision too
    narrow = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast(given if single else "array<double>").alias("embedding"),
        is_query.alias("asks"),
    )
    kept = narrow.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding"), F.max("asks").alias("asks")
    )
    stored = settle(kept.withColumn("length", F.size("embedding")), spark, "vectors")
    sizes = stored.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    n_blocks, n_slices = max(1, -(-sizes[0] // block_vectors)), max(1, -(-sizes[1] // block_queries))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    dealt = stored.select("vec_id", "embedding", "length", deal(n_blocks, 1).alias("block"))
    dealt = dealt.repartition(min(n_blocks, BLOCK_FILES), "length", "block")  # few blocks are not merged into one task
    blocks = settle(dealt.groupBy("length", "block").applyInPandas(pack, BLOCKS), spark, "blocks")
    folder = scratch_dir(spark, "found")
    for i in range(n_slices):
        asking = stored.where(F.col("asks") & (deal(n_slices, 2) == i)).select("vec_id", "embedding", "length")
        shared = spark.sparkContext.broadcast(by_length(asking.toPandas()))
        blocks.mapInArrow(answer(shared, neighbours), FOUND).write.parquet(f"{folder}/{i}")
        shared.destroy()
    found = spark.read.schema(FOUND).parquet(*(f"{folder}/{i}" for i in range(n_slices)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
