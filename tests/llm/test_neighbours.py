from __future__ import annotations

import math

import numpy as np
import pytest
from cases import SF

from visitbook.llm import neighbours as nn
from visitbook.llm.queries import QUERIES
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, asks, k=10):
    usable = {
        i: np.array(e, float) for i, e in rows
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    }
    out = {}
    for q, v in usable.items():
        if asks(q):
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in usable.items() if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in d}) for q, d in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_query_recall_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op2_neighbours"](spark, SF)), brute_force(rows, lambda q: q % 100 == 0)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.99
    for q, near in got.items():
        exact = dict((i, s) for s, i in brute_force(rows, lambda x: x == q, 10**6)[q])
        assert all(abs(exact[i] - s) < 1e-12 for s, i in near)


def test_blocks_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((400, 8)).astype(np.float32)
    data[:150] = data[0]  # one hot vector
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = found(nn.nearest(spark, frame, F.col("vec_id") % 20 == 0, block_vectors=64, block_queries=8))
    want = brute_force([r[:2] for r in rows], lambda q: q % 20 == 0)
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[40] == [(0.0, i) for i in range(10)]
    assert recall(got, want) >= 0.97


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_windows_select(kind):
    """Few vectors are verified, and the nearest are among them."""
    rng = np.random.default_rng(9)
    data = rng.standard_normal((nn.BLOCK_VECTORS, 64))
    if kind == "clusters":
        data = data[rng.integers(0, 100, len(data))] + 0.4 * data
    index, hits, verified = nn.SortedProjections(data), 0, 0
    queries = range(0, len(data), 400)
    for q in queries:
        numbers, distances, n = index.search(data[q], q)
        exact = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        exact[q] = np.inf
        hits += len(set(numbers[np.argsort(distances, kind="stable")[:10]]) & set(np.argsort(exact, kind="stable")[:10]))
        verified += n
    assert hits >= 0.95 * 10 * len(queries)
    assert verified < 0.15 * len(data) * len(queries)


def test_vectors_travel_once(spark, monkeypatch):
    packed = []
    monkeypatch.setattr(nn, "settle", lambda df, s, label, own=nn.settle: packed.append(label) or own(df, s, label))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(6).standard_normal((300, 4)))]
    got = found(nn.nearest(spark, spark.createDataFrame(rows, VECTORS), F.lit(True), block_vectors=50, block_queries=40))
    assert packed == ["vectors", "blocks"] and len(got) == 300


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1),
        (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (8, [0.0, 1.0, 2.0], 1), (None, [1.0, 1.0], 1),
        (9, [0.0, 1.0], None),
    ]
    frame = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "rank")
    got = found(nn.nearest(spark, frame, F.col("vec_id") >= 0))
    assert got == {0: [(0.0, 1), (2**0.5, 9)], 1: [(0.0, 0), (2**0.5, 9)], 9: [(2**0.5, 0), (2**0.5, 1)]}
    assert nn.nearest(spark, spark.createDataFrame([], VECTORS), F.col("vec_id") >= 0).count() == 0
