"""Near-duplicate texts: n-gram Jaccard self-join by chosen paths.

A set walks down a path: at each node it samples one of its shingles, the one that hashes
lowest there, and goes to the child of that shingle; sets that sample a shared shingle stay
together. Nodes of few sets are compared by brute force, larger ones are split again. Several
independent runs bring the recall to its target. Sets are compared whole, so no link is
reported that does not exist.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta
from visitbook.llm.components import components
from visitbook.session import settle

SHINGLE = 5
SIMILARITY = 0.8
# Probability with which a pair at the similarity bound is met, were all its nodes split fully.
RECALL = 0.999
DEPTH = 3
# Chance with which a linked pair may fail the screen by sampled shingles.
SCREEN_LOSS = 1e-6
# Sets in a node that are compared at once; larger nodes are split, or compared block by block.
BRUTE_FORCE = 512
VOCABULARY_BLOCK = 4096


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Independent runs after which a pair shares a path of `depth` nodes with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def least_agreement(functions: int, similarity: float, loss: float = SCREEN_LOSS) -> int:
    """Sampled shingles that two linked sets share but for a chance of `loss`.

    Under each hash function the sets sample the same shingle with the chance of their
    similarity.
    """
    chance = 0.0
    for n in range(functions + 1):
        chance += math.comb(functions, n) * similarity**n * (1 - similarity) ** (functions - n)
        if chance > loss:
            return n
    return functions


def shingles(batch: pa.RecordBatch, size: int, tables: tuple[ta.PowerTables, ta.PowerTables]) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles.

    A text of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    data, bounds = ta.text_bytes(batch.column("text"))
    low, starts, ends, first = ta.words(data, bounds)
    hashes = ta.range_hashes(low.astype(np.uint64), starts, ends, tables[0])
    begin, stop = first[:-1], np.maximum(first[1:] - size + 1, np.minimum(first[:-1] + 1, first[1:]))
    counts = stop - begin
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    to = np.minimum(at + size, np.repeat(first[1:], counts))
    grams = ta.range_hashes(hashes, at, to, tables[1])
    cuts = np.cumsum(counts)
    out = []
    for a, b in zip((cuts - counts).tolist(), cuts.tolist(), strict=True):
        s = np.sort(grams[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def digest(grams: np.ndarray) -> bytes | None:
    """Name of a shingle set, 16 bytes; a text without words has none."""
    if not len(grams):
        return None
    with np.errstate(over="ignore"):
        a, b = grams.sum(dtype=np.uint64), ta.mix(grams + np.uint64(1)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(grams))], ">u8").tobytes()


def sample_values(grams: list[np.ndarray], functions: int) -> np.ndarray:
    """[set, function] lowest hash of each non-empty set under each hash function."""
    sizes = np.array([len(g) for g in grams])
    at, joined = np.cumsum(sizes) - sizes, np.concatenate(grams)
    odd = ta.mix(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(grams), functions), np.uint64)
    for f in range(functions):
        out[:, f] = np.minimum.reduceat(ta.mix(joined * odd[f]), at)
    return out


def sketches(docs: DataFrame, size: int, functions: int) -> DataFrame:
    """doc_id, name of the shingle set, its number of shingles, sampled values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ta.PowerTables(ta.BYTE_BASE), ta.PowerTables(ta.WORD_BASE)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                sets = shingles(batch, size, tables)
                filled = [s for s in sets if len(s)]
                values = iter(sample_values(filled, functions).view(np.int64)) if filled else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(values) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "name", "size", "values"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, name binary, size bigint, values array<bigint>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """name, grams (sorted 64-bit hashes as bytes) of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ta.PowerTables(ta.BYTE_BASE), ta.PowerTables(ta.WORD_BASE)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                sets = [s for s in shingles(batch, size, tables) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["name", "grams"],
                )

    return docs.select("text").mapInArrow(run, "name binary, grams binary")


def chosen_paths(spark: SparkSession, sets: DataFrame, runs: int, depth: int, brute_force: int) -> DataFrame:
    """name, run, bucket, n: the node of several sets at which each set's path ends, per run.

    `values` holds the sampled shingles of run r at r * depth .. r * depth + depth - 1.
    """

    walking = sets.select("name", "values", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    walking = walking.select("name", "run", F.slice("values", F.col("run") * depth + 1, depth).alias("path"))
    ended = []
    for level in range(1, depth + 1):
        walking = walking.withColumn("bucket", F.xxhash64("run", F.slice("path", 1, level)))
        sizes = walking.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        # Written out first, so that the sets of a large node may be split.
        walking = settle(walking.drop("n").join(settle(sizes, spark, "nodes"), "bucket"), spark, "paths")
        small = F.lit(True) if level == depth else F.col("n") <= brute_force
        ended.append(walking.where(small).select("name", "run", "bucket", "n"))
        walking = walking.where(~small)
        if level < depth and walking.isEmpty():
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def unmet(buckets: DataFrame, runs: int) -> DataFrame:
    """The buckets with `before`: each set's buckets of all runs (null: alone).

    A bucket whose sets all share an earlier bucket holds no pair that was not met there.
    """
    per_set = buckets.groupBy("name").agg(*[
        F.max(F.when(F.col("run") == r, F.col("bucket"))).alias(f"b{r}") for r in range(runs)
    ])
    met = F.array(*[f"b{r}" for r in range(runs)])
    rows = per_set.select("name", met.alias("before"), F.posexplode(met).alias("run", "bucket")).where("bucket IS NOT NULL")
    earlier = [F.when(F.col("run") > r, F.col("before")[r]) for r in range(runs - 1)]
    sums = rows.groupBy("bucket").agg(
        F.count("*").alias("n"),
        *[F.count(e).alias(f"c{r}") for r, e in enumerate(earlier)],
        *[F.min(e).alias(f"l{r}") for r, e in enumerate(earlier)],
        *[F.max(e).alias(f"h{r}") for r, e in enumerate(earlier)],
    )
    fresh = F.lit(True)
    for r in range(runs - 1):
        fresh = fresh & ~((F.col(f"c{r}") == F.col("n")) & (F.col(f"l{r}") == F.col(f"h{r}")))
    # Written out first, so that the sets of a large bucket may be split.
    return rows.join(settle(sums.where(fresh).select("bucket", "n"), buckets.sparkSession, "fresh"), "bucket")


def blocks(rows: DataFrame, brute_force: int) -> DataFrame:
    """Adds `part` and `side`: large buckets become pairs of blocks, each compared in one task."""
    count = F.ceil(F.col("n") / brute_force).cast("int")
    own = F.pmod(F.xxhash64("name"), count).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    return (
        rows.withColumns({"count": count, "own": own}).withColumn("other", other)
        .withColumn("part", F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
        .withColumn("side", F.when(F.col("own") == F.col("part.a"), 0).otherwise(1))
        .drop("count", "own", "other", "n")
    )


def linked(grams: list[np.ndarray], similarity: float) -> np.ndarray:
    """[set, set] whether two sets have at least this Jaccard similarity; not with themselves."""
    sizes = np.array([len(g) for g in grams])
    values, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(grams)), sizes), count > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    common = np.zeros((len(grams), len(grams)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), VOCABULARY_BLOCK):
        a, b = np.searchsorted(column, [at, at + VOCABULARY_BLOCK])
        part = np.zeros((len(grams), min(VOCABULARY_BLOCK, int(shared.sum()) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    near = common >= similarity * union - 1e-6
    np.fill_diagonal(near, False)
    return near


def local_roots(near: np.ndarray) -> np.ndarray:
    """Per set the smallest number in its component."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        if (lower == label).all():
            return label
        label = lower


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by bucket and part, as lists of those that meet."""
    rows = ({c: b.column(c)[i].as_py() for c in b.schema.names} for b in batches for i in range(b.num_rows))
    for _, group in groupby(rows, key=lambda r: (r["bucket"], r["a"], r["b"])):
        members = list(group)
        if len(members) > 1:
            yield members


def only_across(near: np.ndarray, members: list[dict]) -> np.ndarray:
    """Of two blocks only the pairs across count; those inside meet in parts of their own."""
    if members[0]["a"] == members[0]["b"]:
        return near
    side = np.array([m["side"] for m in members])
    return near & (side[:, None] != side[None, :])


def screen(agreement: int):
    """Task function over rows sorted by bucket and part: the sets of which another one there
    shares enough sampled shingles for a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for members in together(batches):
            values = np.array([m["values"] for m in members], np.int64)
            same = np.zeros((len(members), len(members)), np.int16)
            for column in values.T:
                same += column[:, None] == column[None, :]
            np.fill_diagonal(same, 0)
            kept = only_across(same >= agreement, members).any(axis=1)
            out += [tuple(m[c] for c in MET) for m, k in zip(members, kept, strict=True) if k]
            if len(out) > 5000:
                yield met_rows(out)
                out = []
        yield met_rows(out)

    return run


# Rows of sets that meet in a part of a bucket.
MET = ("bucket", "a", "b", "run", "side", "name", "before", "copies")
MET_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64())
MET_SCHEMA = "bucket bigint, a int, b int, run int, side int, name binary, before array<bigint>, copies bigint"


def met_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(MET)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MET_KINDS, strict=True)], names=list(MET))


def compare(similarity: float):
    """Task function over rows sorted by bucket and part: what each set is linked to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for members in together(batches):
            near = only_across(linked([np.frombuffer(m["grams"], np.uint64) for m in members], similarity), members)
            if not near.any():
                continue
            root, fresh = local_roots(near), near.copy()
            for r in range(members[0]["run"]):  # pairs that met in an earlier run were counted there
                other = np.array([m["before"][r] or 0 for m in members])
                fresh &= (other[:, None] != other[None, :]) | (other == 0)[:, None]
            weight = np.array([m["copies"] for m in members])
            links = fresh @ weight
            out += [
                (members[i]["name"], members[root[i]]["name"], int(links[i])) for i in np.flatnonzero(near.any(axis=1))
            ]
            if len(out) > 5000:
                yield link_rows(out)
                out = []
        if out:
            yield link_rows(out)

    return run


def link_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.binary(), pa.binary(), pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "root", "links"]
    )


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    recall: float = RECALL, depth: int = DEPTH, brute_force: int = BRUTE_FORCE,
) -> DataFrame:
    """doc_id, class_id, n_links for every row of `docs`.

    Texts are compared as sets of `shingle` consecutive words, A-Z lower-cased. `class_id` is
    the smallest doc_id among the documents that links of at least `similarity` connect;
    `n_links` is the number of other documents linked directly, copies included. Copies are
    one set: they are never paired among themselves. Texts without words (null, empty) have no
    links and are a class each. Equal rows are copies of each other. A null doc_id is a
    document like others, but names no class as long as another member has an id.
    """
    runs = runs_for(recall, similarity, depth)
    named = settle(sketches(docs, shingle, runs * depth), spark, "sketches")
    worded = named.where("name IS NOT NULL")
    classes = settle(
        worded.groupBy("name").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("values").alias("values")
        ),
        spark, "classes",
    )
    buckets = chosen_paths(spark, classes, runs, depth, brute_force)
    rows = settle(unmet(settle(buckets, spark, "buckets"), runs), spark, "unmet")

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    dealt = blocks(rows.join(classes.select("name", "copies", "values"), "name"), brute_force)
    dealt = dealt.select("bucket", "part.a", "part.b", "run", "side", "name", "before", "copies", "values")
    agreement = least_agreement(runs * depth, similarity)
    met = settle(gathered(dealt).mapInArrow(screen(agreement), MET_SCHEMA), spark, "met")

    # Whole sets of the classes that have anything to compare, taken from their first document.
    wanted = met.select("name").distinct().join(classes.select("name", "first_id"), "name")
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").alias("d").join(
        ids.alias("i"), F.expr("d.doc_id <=> i.doc_id"), "left_semi"
    )
    sets = shingle_sets(texts, shingle).dropDuplicates(["name"])
    compared = gathered(met.join(sets, "name"))
    links = settle(compared.mapInArrow(compare(similarity), "name binary, root binary, links bigint"), spark, "links")
    roots = components(spark, links.select(F.col("name").alias("u"), F.col("root").alias("v")))

    counted = links.groupBy("name").agg(F.sum("links").alias("links"))
    rooted = classes.select("name", "first_id", "copies").join(
        roots.withColumnRenamed("node", "name"), "name", "left"
    ).withColumn("root", F.coalesce("root", "name"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    verdicts = rooted.join(lowest, "root").join(counted, "name", "left").select(
        "name", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = named.where("name IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return worded.select("doc_id", "name").join(verdicts, "name").select("doc_id", "class_id", "n_links").unionByName(alone)


def deduplicate(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The columns of `docs`; of each class only the document with the smallest doc_id.

    Rows that are equal in id and text give one row. Texts without words stay, and so do
    documents without an id that share no class with one that has an id.
    """
    near = near_duplicates(spark, docs, **options)
    kept = near.where("doc_id <=> class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])
