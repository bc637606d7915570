from __future__ import annotations

import random
from collections import defaultdict

import pytest
from cases import SF, awkward, documents, empty, words
from pyspark.sql import functions as F

from visitbook.llm import components as components_module
from visitbook.llm import jaccard_join as jj
from visitbook.llm.components import components
from visitbook.llm.queries import QUERIES
from visitbook.session import settle


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_force(docs, similarity=0.8):
    """doc_id -> (class_id, n_links), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    common = defaultdict(int)
    owners = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            owners[g].append(d)
    for ds in owners.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    near, links = {d: {d} for d in sets}, defaultdict(int)
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            joined = near[a] | near[b]
            for d in joined:
                near[d] = joined
    return {d: (min(near[d]), links[d]) for d in sets}


def found(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(QUERIES["op9_jaccard_join"](spark, SF))
    assert got == brute_force(docs)
    assert sum(n > 0 for _, n in got.values()) > 5


@pytest.fixture(scope="module")
def group(spark):
    """One large group of near copies and of exact ones, and texts that share a passage."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        if i % 3:
            for _ in range(rng.choice([1, 2, 4])):
                t[rng.randrange(120)] = f"edit{i}x{rng.randrange(99)}"
        texts.append(" ".join(t))
    passage = " ".join(base[:60])
    texts += [" ".join([passage, *[f"own{i}n{j}" for j in range(60)]]) for i in range(60)]
    return texts


@pytest.mark.parametrize("brute", [512, 16, 4])
def test_large_groups_are_compared_block_by_block(spark, group, brute):
    got = found(jj.near_duplicates(spark, documents(spark, group), brute_force=brute))
    assert got == brute_force(list(enumerate(group)))


def test_one_of_each_group_stays(spark, group):
    kept = sorted(r.doc_id for r in jj.deduplicate(spark, documents(spark, group)).collect())
    assert kept == sorted({c for c, _ in brute_force(list(enumerate(group))).values()})


def test_awkward_rows(spark):
    rows = jj.near_duplicates(spark, awkward(spark).withColumnRenamed("lang", "name")).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.class_id, r.n_links))
    assert got[1] == [(1, 2), (1, 2)] and got[2] == [(1, 2)]
    assert got[3] == [(3, 0)] and got[4] == [(4, 0)] and got[5] == [(5, 0)] and got[None] == [(None, 0)]
    assert len(rows) == 11
    stay = jj.deduplicate(spark, awkward(spark))
    assert stay.columns == awkward(spark).columns
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert jj.near_duplicates(spark, empty(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, None)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


@pytest.fixture
def skewed_plans(spark, monkeypatch):
    """Plans of what is written out, under settings that let small joins be split."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    plans = []

    def recorded(df, session, label):
        df.collect()
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, session, label)

    for module in (jj, components_module):
        monkeypatch.setattr(module, "settle", recorded)
    for k, v in options.items():
        spark.conf.set(k, v)
    yield plans
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_edges_of_a_hot_node_are_split(spark, skewed_plans):
    node = F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 97)
    edges = spark.range(0, 60_000, 1, 8).select(node.alias("u"), (F.col("id") + 1000).alias("v"))
    star = components_module._large_star(edges)
    star.collect()
    assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()


def test_sets_of_a_hot_node_are_split(spark, skewed_plans):
    """Most sets share all sampled shingles, so they go down one path and meet in one bucket."""
    same = F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id"))
    sets = spark.range(0, 8000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("name"),
        F.array(*[(same * 31 + i).cast("bigint") for i in range(6)]).alias("values"),
    )
    buckets = jj.chosen_paths(spark, sets, 1, 3, 16)
    assert [label for label, text in skewed_plans if label == "paths" and "skew=true" in text]
    met = jj.unmet(settle(buckets, spark, "buckets"), 1)
    met.collect()
    assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
