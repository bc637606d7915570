from __future__ import annotations

import datetime as dt
import pathlib

import pyarrow.parquet as pq
import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from visitbook.operators import audit, quality, series
from visitbook.plans import stand_ins
from visitbook.plans.catalog import QUERIES
from visitbook.schemas import ACTION_LOGS, PATIENTS, VISITS
from visitbook.session import finished_batches, remove_folder, scratch_dir
from visitbook.sources import logs
from visitbook.sources.results import write_result
from visitbook.sources.visits import read_visits
from visitbook.streaming import jobs

T = dt.datetime


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, T(2024, 5, 1, 0, 0), "infirmiers", "login", None),
        (2, T(2024, 5, 1, 23, 59, 59), None, "logout", "a, b"),
        (3, T(2024, 5, 2, 0, 0), "", "login", "x"),
        (4, T(2024, 5, 1, 8, 0), "u", "view", ""),
    ]
    return spark.createDataFrame(rows, ACTION_LOGS)


def test_log_range_is_half_open(log):
    day = audit.log_order(audit.log_range(log, "2024-05-01"))
    assert [r.id for r in day.collect()] == [1, 4, 2]


def test_log_range_reaches_the_scan(spark):
    events = stand_ins.log(stand_ins.table(spark, SF, "events"))
    text = plan(audit.log_range(events, "2024-01-10"))
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00)" in text and "LessThan(ts,2024-01-11T00:00)" in text


def test_digest(log):
    lines = audit.daily_digest(log).orderBy("log_date", F.asc_nulls_first("ts"), "id").collect()
    assert [r.line for r in lines] == [
        "Action Logs Report for 2024-05-01",
        "UserType: infirmiers | Action: login | Details: ",
        "UserType: u | Action: view | Details: ",
        "UserType: unknown | Action: logout | Details: a, b",
        "Action Logs Report for 2024-05-02",
        "UserType: unknown | Action: login | Details: x",
    ]


def test_written_digest_is_in_order(spark, tmp_path):
    """Also when a day is split over several files."""
    digest = audit.daily_digest(stand_ins.log(stand_ins.table(spark, SF, "events")))
    audit.write_digest(digest, str(tmp_path / "digest"))
    days = sorted(p for p in (tmp_path / "digest").iterdir() if p.is_dir())
    assert len(days) == 30
    for folder in days:
        day = folder.name.split("=")[1]
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        rows = digest.where((F.col("log_date") == day) & F.col("ts").isNotNull()).orderBy("ts", "id").collect()
        assert text == f"Action Logs Report for {day}\n\n" + "".join(r.line + "\n" for r in rows)
        if day == "2024-01-05":
            break


def test_read_log_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(
        "2024-05-01\nNouvelle evenement: 09:15:02 infirmiers, Détails des patients, a, b\n"
        "2023-01-01\nnoise é\nNouvelle evenement: 09:15:03 x, Facture généré, None".encode("latin-1")
    )
    (tmp_path / "b.txt").write_bytes(b"2024-05-02\r\nNouvelle evenement: 00:00:00 y, login, z\r\n")
    (tmp_path / "c.txt").write_bytes(b"no header\nNouvelle evenement: 01:00:00 y, login, z\n")
    rows = logs.read_log_files(spark, str(tmp_path)).collect()
    got = sorted((pathlib.Path(r.file).name, r.ts, r.user_type, r.action, r.details, r.line[:5]) for r in rows if r.ts)
    assert got == [
        ("a.txt", T(2024, 5, 1, 9, 15, 2), "infirmiers", "Détails des patients", "a, b", "Nouve"),
        ("a.txt", T(2024, 5, 1, 9, 15, 3), "x", "Facture généré", "None", "Nouve"),
        ("b.txt", T(2024, 5, 2), "y", "login", "z", "Nouve"),
    ]
    unread = sorted((pathlib.Path(r.file).name, r.line[:9]) for r in rows if r.ts is None)
    assert unread == [("a.txt", "2023-01-0"), ("a.txt", "noise é"), ("c.txt", "Nouvelle "), ("c.txt", "no header")]


def test_read_split_log_file(spark, tmp_path):
    """A file of several splits keeps the day of its first line."""
    lines = [f"Nouvelle evenement: {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d} u, a, {i}" for i in range(3000)]
    (tmp_path / "big.txt").write_bytes(("2024-05-01\n" + "\n".join(lines)).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = logs.read_log_files(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and {r.ts.date() for r in rows} == {dt.date(2024, 5, 1)}
    assert sorted(int(r.details) for r in rows) == list(range(3000))


def test_log_table(spark, log, tmp_path):
    path = str(tmp_path / "log")
    logs.write_log(log, path)
    logs.write_log(log.where("id = 3").withColumn("id", F.lit(5).cast("long")), path)
    stored = logs.read_log(spark, path)
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in logs.on_day(stored, "2024-05-02").collect()) == [3, 5]
    assert "PartitionFilters: [isnotnull(log_date" in plan(logs.on_day(stored, "2024-05-02"))


def test_read_visits(spark, tmp_path):
    values = {"id": 1, "name": " Élodie\t", "created_at": dt.date(2024, 1, 1)}
    row = tuple(values.get(n) for n in PATIENTS.names)
    write_result(spark.createDataFrame([row], PATIENTS), str(tmp_path / "v"))
    write_result(spark.createDataFrame([row], PATIENTS), str(tmp_path / "v"))
    df = read_visits(spark, str(tmp_path / "v"))
    assert df.columns == PATIENTS.names
    assert [(r.name, r.created_at) for r in df.collect()] == [("Elodie", dt.date(2024, 1, 1))]


def test_partitioned_result(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    write_result(df, str(tmp_path / "r"), ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [(1, "a"), (2, "b")]


def test_quality(spark):
    visits = spark.createDataFrame([(1, 1, None, None), (2, 9, None, None), (3, None, None, None)], VISITS)
    patients = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in quality.orphan_visits(visits, patients).collect()] == [2]
    df = spark.createDataFrame([("a", None), (None, None)], "name string, action string")
    report = quality.required_field_report(df, ["name", "action"])
    assert {r.field: r.n_missing for r in report.collect()} == {"name": 1, "action": 2}


@pytest.mark.parametrize("name,batch", [("stream_log", None), ("stream_notifications", "notifications")])
def test_streams_equal_batch(spark, name, batch):
    got = QUERIES[name](spark, SF)
    want = QUERIES[batch](spark, SF) if batch else (
        stand_ins.log(stand_ins.table(spark, SF, "events"))
        .withColumn("log_date", F.to_date("timestamp")).select(*got.columns)
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_daily_stream_over_several_runs(spark, tmp_path):
    """Two runs share a checkpoint; a late visit of the second still counts."""
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "created_at timestamp_ntz"

    def arrive(*times):
        spark.createDataFrame([(t,) for t in times], schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.stream_daily_visits(stream, f"{out}/t", f"{out}/c").awaitTermination()
        return {r.day.day: r.n for r in jobs.read_daily_series(spark, f"{out}/t").collect()}

    assert arrive(T(2024, 5, 3, 10), T(2024, 5, 3, 11)) == {3: 2}
    assert arrive(T(2024, 5, 1, 9), T(2024, 5, 3, 12)) == {1: 1, 2: 0, 3: 3}
    assert arrive(T(2024, 5, 4)) == {1: 1, 2: 0, 3: 3, 4: 1}


def test_daily_series_before_the_first_trigger(spark, tmp_path):
    assert jobs.read_daily_series(spark, f"{tmp_path}/none").collect() == []


def test_old_versions_of_the_daily_series_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "KEPT_VERSIONS", 2)
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(4):
        spark.createDataFrame([(T(2024, 5, 1, i),)], "created_at timestamp_ntz").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("created_at timestamp_ntz").parquet(str(source))
        jobs.stream_daily_visits(stream, f"{out}/t", f"{out}/c").awaitTermination()
    assert finished_batches(spark, f"{out}/t") == [2, 3]
    (out / "t" / "batch_id=9").mkdir()  # a version that is still being written
    assert [r.n for r in jobs.read_daily_series(spark, f"{out}/t").collect()] == [4]


def test_stream_log_writes_few_files(spark, tmp_path):
    events = stand_ins.log(stand_ins.stream(spark, SF, "events"))
    jobs.stream_log(events, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    days = list((tmp_path / "t").glob("batch_id=*/log_date=*"))
    assert len(days) == 30 and all(len(list(d.glob("part-*"))) == 1 for d in days)
    assert logs.read_log(spark, f"{tmp_path}/t").columns[-1] == "log_date"


def test_lines_of_a_hot_file_are_split(spark):
    """One file holds nearly all lines; without a broadcast its lines still go to several tasks."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    hot = F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string"))
    no, text = F.when(F.col("id") < 10, F.col("id")), F.concat(F.lit("noise "), F.sha2(F.col("id").cast("string"), 512))
    lines = spark.range(0, 20000, 1, 8).select(hot.alias("file"), no.alias("line_no"), text.alias("line"))
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        df = logs.parse_log_lines(lines)
        assert len(df.collect()) == 20000
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_daily_stream_equals_batch(spark):
    events = stand_ins.table(spark, SF, "events")
    want = series.with_revenue(series.daily_visits(events, "ts")).collect()
    assert sorted(QUERIES["stream_daily"](spark, SF).collect()) == sorted(want)


def test_folders_can_be_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    remove_folder(spark, f"{tmp_path}/x")
    assert not (tmp_path / "x").exists()


def test_scratch_dir_is_shared_and_fresh(spark):
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert not shared or a.startswith(shared)


def test_a_part_of_a_stream_is_one_file_of_many_row_groups(spark, tmp_path, monkeypatch):
    rows = spark.range(300_000).select("id", F.rand(1).alias("x"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stand_ins, "scratch_dir", lambda *_: str(tmp_path / "parts"))
    stand_ins.stream_in_parts(spark, str(tmp_path), "events", "id", 3)
    files = sorted((tmp_path / "parts").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 3 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
    spans = [(min(ids), max(ids), len(ids)) for ids in (pq.read_table(f)["id"].to_pylist() for f in files)]
    assert spans == [(0, 99_999, 100_000), (100_000, 199_999, 100_000), (200_000, 299_999, 100_000)]
