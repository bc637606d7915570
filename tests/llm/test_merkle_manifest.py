from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pytest
from cases import SF, awkward, documents, empty
from conftest import plan
from pyspark.sql import functions as F

from visitbook.llm import merkle_manifest as mm
from visitbook.llm import queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per leaf the (before, after) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            k = at[i]
            lo = k // 16 * 16
            p.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 16])))
            at[i] = k // 16
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    """op12's result as sorted tuples."""
    leaf = lambda r: H("".join(field(r[c]) for c in FIELDS))
    rows = sorted(rows, key=lambda r: (
        r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [(s, list(g)) for s, g in itertools.groupby(rows, key=lambda r: r["source"])]
    built = [climb([leaf(r) for r in g]) for _, g in trees]
    root, tops = climb([b[0] for b in built]) if built else (None, [])
    out = []
    for (_, group), (subroot, paths), top in zip(trees, built, tops, strict=True):
        for r, path in zip(group, paths, strict=True):
            steps = path + top
            node = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                lowered = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
                node = leaf({**r, "text": lowered})
            for a, b in steps:
                node = H(a + node + b)
            out.append((r["doc_id"], leaf(r), subroot, root, H("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert df.columns == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_query_equals_brute_force(spark):
    found = queries.op12_merkle_manifest(spark, SF).collect()
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in found], key=repr) == brute(rows)
    assert {r["verified"] for r in found} == {True, False}


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark).withColumn("digest", F.lit(1)).withColumn("tree", F.lit("x"))
    rows = [r.asDict() for r in awkward(spark).collect()]
    assert run(spark, docs, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, empty(spark), tmp_path) == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_group_sizes(spark, tmp_path, n):
    """A hot source beside lone ones, at the bounds of runs and of stored levels."""
    rows = [(i, f"Text {i}", "en", "hot", 3) for i in range(n)] + [(-5, "A", None, None, 1), (10**12, "b", "en", "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert run(spark, docs, tmp_path) == brute([r.asDict() for r in docs.collect()])


def test_many_groups(spark, tmp_path):
    """More sources than one stored block of the upper tree."""
    rows = [(i, f"T{i}", "en", f"s{i % 700}", 2) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert run(spark, docs, tmp_path) == brute([r.asDict() for r in docs.collect()])


def test_wanted_rows_and_forged_leaf(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    m = mm.build_manifest(spark, docs, F.col("source"), F.col("doc_id"), mm.leaf_digest(F.col("doc_id")), {"doc_id": F.col("doc_id")})
    assert len(m.items) == 3  # leaves, one stored level between, and the root
    asked = mm.proofs(m, F.col("_doc_id").isin(7, 2999))
    rows = asked.select("doc_id", "root", mm.folded_root(F.col("digest"), F.col("path")).alias("good"),
                        mm.folded_root(F.sha2(F.lit("forged"), 256), F.col("path")).alias("bad")).collect()
    assert sorted(r["doc_id"] for r in rows) == [7, 2999]
    assert all(r["good"] == m.root == r["root"] and r["bad"] != m.root for r in rows)


def test_no_python_in_the_plan(spark):
    text = plan(queries.op12_merkle_manifest(spark, SF), "simple")
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
