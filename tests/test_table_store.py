"""The stored table in buckets, changed by batches and by a stream."""

from __future__ import annotations

import pathlib
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F
from test_changes import batch, delete, insert, simulate, update

from visitbook.plans.requests import conform
from visitbook.schemas import CHANGES
from visitbook.sources import table_store as ts
from visitbook.streaming import jobs


def apply(spark, table, rows, version):
    return ts.apply_batch(spark, table, rows, version, F.col("received_at"))


@pytest.fixture
def stored(spark, tmp_path):
    """A table of the given ids in some buckets."""

    def create(ids, buckets=8):
        table = ts.StoredTable(str(tmp_path / "table"), buckets)
        rows = spark.createDataFrame([(i, f"n{i}", "s") for i in ids], "id bigint, name string, adresse string")
        ts.create_table(spark, table, conform(rows))
        return table

    return create


def files(table, part="rows"):
    root = pathlib.Path(table.path) / part
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def contents(df):
    return {r.id: {"name": r.name, "adresse": r.adresse} for r in df.collect()}


def bucket(spark, table, id):
    return spark.range(1).select(ts.bucket_of(F.lit(id).cast("bigint"), table.buckets)).first()[0]


def test_only_named_buckets_are_rewritten(spark, stored):
    table = stored(range(200))
    before = files(table)
    out = apply(spark, table, batch(spark, update(1, 3, name="X"), delete(2, 5), update(3, 999, name="Y")), 1)
    rows = contents(out.rows)
    assert rows[3]["name"] == "X" and 5 not in rows and 999 not in rows and len(rows) == 199
    after = files(table)
    assert before.items() <= after.items()  # no file was touched
    named = {bucket(spark, table, i) for i in (3, 5, 999)}
    assert {int(f.split("/")[0].split("=")[1]) for f in after.keys() - before.keys()} <= named
    held = ts.bucket_versions(spark, table)
    assert {b for b in range(8) if held[b] == 1} == named
    assert [(r.id, r.seq, r.name) for r in out.deleted.collect()] == [(5, 2, "n5")]


def test_reading_prunes_buckets_and_versions(spark, stored):
    table = stored(range(100))
    apply(spark, table, batch(spark, update(1, 3, name="X")), 1)
    found = ts.rows_by_id(spark, table, 3)
    assert [r.name for r in found.collect()] == ["X"]
    text = plan(found.select("name"))
    assert "PartitionFilters" in text and "EqualTo(id,3)" in text and "ReadSchema: struct<id:bigint,name:string>" in text
    scanned = plan(ts.read_table(spark, table, buckets=[1]).select("id"))
    assert "bucket" in scanned.split("PartitionFilters")[1].split("\n")[0]


def test_older_versions_stay_readable_until_removed(spark, stored):
    table = stored(range(50), 4)
    for v in range(1, 6):
        apply(spark, table, batch(spark, update(v, 7, name=f"v{v}"), update(v + 100, v, name=f"w{v}")), v)
    assert contents(ts.read_table(spark, table, 2))[7]["name"] == "v2"
    now = contents(ts.read_table(spark, table))
    ts.remove_old(spark, table, keep=2)
    assert ts.versions(spark, table) == [4, 5]
    assert contents(ts.read_table(spark, table)) == now and contents(ts.read_table(spark, table, 4))[7]["name"] == "v4"
    held = {(b, v) for version in (4, 5) for b, v in enumerate(ts.bucket_versions(spark, table, version))}
    left = {tuple(int(p.split("=")[1]) for p in f.split("/")[:2]) for f in files(table)}
    assert left <= held


def test_a_bucket_may_become_empty_and_fill_again(spark, stored):
    table = stored([1, 2], 1)
    apply(spark, table, batch(spark, delete(1, 1), delete(2, 2)), 1)
    assert contents(ts.read_table(spark, table)) == {}
    apply(spark, table, batch(spark, insert(3, 9)), 2)
    assert list(contents(ts.read_table(spark, table))) == [9]


def test_batch_without_accepted_changes(spark, stored):
    table = stored([1])
    before = files(table)
    out = apply(spark, table, batch(spark, update(1, 1, name="")), 1)
    assert contents(out.rows)[1]["name"] == "n1" and out.deleted.isEmpty()
    assert [list(r.errors) for r in out.rejected.collect()] == [["name is required"]]
    assert files(table) == before


def test_repeated_and_interrupted_batches(spark, stored, monkeypatch):
    """A complete version isn't applied again; one that broke off is written anew."""
    table = stored(range(20))
    first = batch(spark, delete(1, 3), insert(2, 3), update(3, 4, name="B"))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ts, "_complete", broken)
        with pytest.raises(RuntimeError):
            apply(spark, table, first, 1)
    assert contents(ts.read_table(spark, table))[4]["name"] == "n4"  # nothing of it is seen
    expected = contents(apply(spark, table, first, 1).rows)
    assert expected[4]["name"] == "B" and expected[3]["name"] == "Ana"
    written = files(table)
    again = apply(spark, table, first, 1)
    assert contents(again.rows) == expected and files(table) == written
    assert [(r.id, r.seq) for r in ts.read_outcomes(spark, table, "deleted").collect()] == [(3, 1)]


def test_late_changes_are_refused(spark, stored):
    table = stored(range(5))
    apply(spark, table, batch(spark, update(10, 1, name="A"), delete(11, 2)), 1)
    late = batch(spark, update(10, 1, name="B"), update(5, 1, name="C"), insert(9, 2), update(3, 3, name="D"), update(12, 1, name="E"))
    out = apply(spark, table, late, 2)
    rows = contents(out.rows)
    assert rows[1]["name"] == "E" and 2 not in rows and rows[3]["name"] == "D"
    assert {(r.seq, r.id): list(r.errors) for r in out.rejected.collect()} == {
        (10, 1): ["seq is too late"], (5, 1): ["seq is too late"], (9, 2): ["seq is too late"]}
    assert {r.id: r.last_seq for r in ts.read_heads(spark, table).collect()} == {1: 12, 2: 11, 3: 3}


def random_changes(seed, n):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        id = 1 if rng.random() < 0.4 else rng.randrange(9)
        fields = {"name": f"v{seq}"} | ({"adresse": rng.choice(["", f"a{seq}"])} if rng.random() < 0.5 else {})
        kind = rng.choice(["insert", "update", "update", "delete"])
        out.append({"insert": insert, "update": update}[kind](seq, id, **fields) if kind != "delete" else delete(seq, id))
    return out


def test_stream_equals_one_by_one(spark, stored, tmp_path):
    """Several triggers, and the last one repeated as if the checkpoint had not been written."""
    rows = random_changes(5, 120)
    source = str(tmp_path / "source")
    for k in range(3):
        batch(spark, *rows[k * 40 : (k + 1) * 40]).coalesce(1).write.mode("append").parquet(source)
    table = stored(range(6))
    stream = spark.readStream.schema(batch(spark, *rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
    checkpoint = tmp_path / "checkpoint"
    jobs.stream_changes(stream, table, str(checkpoint), F.col("received_at")).awaitTermination()
    start = {i: {"name": f"n{i}", "adresse": "s"} for i in range(6)}
    expected, images, refused = simulate(start, rows)

    def check():
        assert contents(ts.read_table(spark, table)) == expected
        deleted = ts.read_outcomes(spark, table, "deleted").collect()
        assert {(r.id, r.seq): {"name": r.name, "adresse": r.adresse} for r in deleted} == images
        assert sorted(r.seq for r in ts.read_outcomes(spark, table, "rejected").collect()) == sorted(refused)
        assert ts.versions(spark, table) == [0, 1, 2, 3]

    check()
    for name in ("2", ".2.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    jobs.stream_changes(stream, table, str(checkpoint), F.col("received_at")).awaitTermination()
    check()


def test_empty_table_and_empty_batch(spark, stored):
    table = stored([])
    assert ts.read_table(spark, table).isEmpty()
    nothing = spark.createDataFrame([], batch(spark, insert(1, 1)).schema)
    assert apply(spark, table, nothing, 1).rows.isEmpty()
    assert contents(apply(spark, table, batch(spark, insert(1, 1)), 2).rows).keys() == {1}
    assert set(CHANGES.names) <= set(nothing.columns)
