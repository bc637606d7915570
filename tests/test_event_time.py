"""Streams that close days, and the stored log they read."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitbook.operators import audit, series
from visitbook.schemas import ACTION_LOGS
from visitbook.sources import logs
from visitbook.streaming import jobs

T = dt.datetime


@pytest.fixture
def arrivals(spark, tmp_path):
    """A source folder that grows, and a stream over it."""
    schema = "created_at timestamp_ntz"

    def arrive(*times):
        spark.createDataFrame([(t,) for t in times], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for job in jobs.stream_closed_days(stream, f"{tmp_path}/t", f"{tmp_path}/c", delay="12 hours"):
            job.awaitTermination()
        closed = {r.day.day: r.n for r in jobs.read_closed_series(spark, f"{tmp_path}/t").collect()}
        return closed, {r.day.day: r.n for r in jobs.late_visits(spark, f"{tmp_path}/t").collect()}

    return arrive


def test_days_are_closed_once_and_late_visits_are_counted(arrivals):
    assert arrivals(T(2024, 5, 1, 9), T(2024, 5, 1, 10), None) == ({}, {})
    assert arrivals(T(2024, 5, 2, 11)) == ({}, {})  # within the delay
    assert arrivals(T(2024, 5, 2, 13), T(2024, 5, 1, 11)) == ({1: 3}, {})  # late, but in time
    assert arrivals(T(2024, 5, 1, 12), T(2024, 5, 2, 14)) == ({1: 3}, {1: 1})
    assert arrivals(T(2024, 5, 5, 1)) == ({1: 3, 2: 3}, {1: 1})
    assert arrivals(T(2024, 5, 3, 1), T(2024, 5, 1, 1), T(2024, 5, 9, 0)) == ({1: 3, 2: 3, 3: 0, 4: 0, 5: 1}, {1: 2, 3: 1})


def test_before_the_first_trigger(spark, tmp_path):
    assert jobs.read_closed_series(spark, f"{tmp_path}/none").isEmpty()
    assert jobs.late_visits(spark, f"{tmp_path}/none").isEmpty()
    assert jobs.read_digests(spark, f"{tmp_path}/none").isEmpty()


def events(spark, rows):
    return spark.createDataFrame([(i, t, "u", "login", f"d{i}") for i, t in rows], ACTION_LOGS)


def test_digests_are_written_once_when_a_day_closes(spark, tmp_path):
    log = f"{tmp_path}/log"

    def arrive(*rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ACTION_LOGS).parquet(f"{tmp_path}/in")
        jobs.stream_log(stream, log, f"{tmp_path}/c1").awaitTermination()
        jobs.stream_digest(spark, log, f"{tmp_path}/d", f"{tmp_path}/c2", delay="1 hour").awaitTermination()
        return sorted(map(tuple, jobs.read_digests(spark, f"{tmp_path}/d").collect()))

    def want(*days):
        digest = audit.daily_digest(logs.read_log(spark, log)).where(F.col("log_date").isin(*days))
        return sorted((r.log_date, r.line) for r in digest.collect())

    first, second = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    assert arrive((1, T(2024, 5, 1, 8)), (2, T(2024, 5, 1, 9))) == []
    digest = arrive((3, T(2024, 5, 1, 7)), (4, T(2024, 5, 2, 5)))
    assert digest == want(first) and len(digest) == 4
    again = arrive((5, T(2024, 5, 1, 6)), (6, T(2024, 5, 4, 5)))  # too late for the first day
    assert again == sorted(digest + want(second))


def test_a_log_of_many_triggers_keeps_few_folders(spark, tmp_path):
    """20 triggers over two days; what is read stays the same, exactly, after every compaction."""
    log = tmp_path / "log"
    rows = [(i, T(2024, 5, 1 + i % 2, i % 24)) for i in range(40)]
    for k in range(20):
        logs.write_log(events(spark, rows[2 * k : 2 * k + 2]), f"{log}/batch_id={k}", mode="overwrite")
        if k in (9, 12, 19):
            logs.compact_log(spark, str(log), tier=3)
            read = logs.read_log(spark, str(log))
            assert sorted(r.id for r in read.collect()) == list(range(2 * k + 2))
            # At most two folders each of single triggers, of 3 and of 9.
            assert len(logs._uncovered(logs._spans(spark, str(log)))) <= 6
    files = {f.split("/log_date=")[0] for f in read.inputFiles()}
    assert len(files) <= 6
    logs.compact_log(spark, str(log), tier=3)
    assert len(list(log.glob("batch_id=*"))) <= 6  # what was covered is gone
    assert sorted(r.id for r in logs.read_log(spark, str(log)).collect()) == list(range(40))
    assert logs.read_log(spark, str(log)).columns[-1] == "log_date"


def test_an_unfinished_merge_is_not_read(spark, tmp_path):
    log = tmp_path / "log"
    for k in range(3):
        logs.write_log(events(spark, [(k, T(2024, 5, 1))]), f"{log}/batch_id={k}", mode="overwrite")
    (log / "batch_id=0-2" / "log_date=2024-05-01").mkdir(parents=True)
    assert sorted(r.id for r in logs.read_log(spark, str(log)).collect()) == [0, 1, 2]


def test_a_repeated_header_line_does_not_depend_on_splits(spark, tmp_path):
    """The date again in the middle of a file is a line like any other, in every block."""
    body = [f"Nouvelle evenement: 10:00:00 u, a, {i}" for i in range(400)]
    (tmp_path / "l.txt").write_bytes("\n".join(["2024-05-01", "2024-05-01", *body, "2024-05-01", *body]).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    counts = []
    try:
        for size in ("128m", "4096", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = sorted((r.line, str(r.ts)) for r in logs.read_log_files(spark, str(tmp_path)).collect())
            counts.append(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == 802


def test_closed_days_equal_the_batch(spark):
    from conftest import SF

    from visitbook.plans import stand_ins
    from visitbook.plans.catalog import QUERIES

    events_ = stand_ins.table(spark, SF, "events")
    last = events_.agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    want = [r for r in series.with_revenue(series.daily_visits(events_, "ts")).collect()
            if dt.datetime.combine(r.day, dt.time()) + dt.timedelta(days=1) <= last]
    assert sorted(QUERIES["stream_closed_days"](spark, SF).collect()) == sorted(want)
