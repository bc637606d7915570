"""Tables laid out for their questions, statistics that follow them, and metrics of writes."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F
from test_changes import batch, delete, insert, update

from visitbook.operators import distribution, history, quality, search, series
from visitbook.plans import stand_ins
from visitbook.plans.requests import conform
from visitbook.sources import running_counts as rc
from visitbook.sources import table_store as ts
from visitbook.sources import visit_layout


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    visits = stand_ins.visits(spark, SF).unionByName(
        spark.createDataFrame([(-1, "nobody", None)], "id bigint, name string, created_at timestamp_ntz"), allowMissingColumns=True
    )
    visit_layout.store_visits(visits, "visits_test", str(tmp_path_factory.mktemp("layout") / "v"), buckets=3)
    yield visits
    spark.sql("DROP TABLE visits_test")


def test_a_span_of_days_reads_its_months_only(spark, laid_out):
    found = visit_layout.between(spark.table("visits_test"), "1995-03-20", "1995-05-10")
    text = plan(found.select("created_at"))
    assert re.search(r"PartitionFilters: \[[^\n]*month#\d+ >= 1995-03-01[^\n]*month#\d+ <= 1995-05-01", text)
    day = F.to_date("created_at")
    want = laid_out.where(day.between("1995-03-20", "1995-05-10"))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    months = {r[0] for r in found.select(F.trunc("created_at", "MM")).distinct().collect()}
    assert months == {dt.date(1995, m, 1) for m in (3, 4, 5)}


def test_history_exchanges_no_visits(spark, laid_out):
    ids = spark.createDataFrame([(7,), (8,), (-1,), (7,), (10**9,)], "id bigint")
    found = visit_layout.history_in_buckets(spark, "visits_test", ids)
    want = history.visit_history(laid_out, ids)
    columns = ["id", "name", "n_visits"]
    assert sorted(found.select(columns).collect()) == sorted(want.select(columns).collect())
    text = plan(found, "simple")
    # What is exchanged are the wanted names alone; both scans of the visits stay where they are.
    assert text.count("Bucketed: true") == 2 and text.count("Exchange hashpartitioning") <= 1
    assert not re.search(r"Exchange hashpartitioning\(name[^\n]*\n[^\n]*(HashAggregate|FileScan)[^\n]*(count|visits)", text)


def test_undated_visits_are_kept(spark, laid_out):
    stored = spark.table("visits_test")
    assert stored.count() == laid_out.count() and stored.where("month IS NULL").first().name == "nobody"


# --- running counts ------------------------------------------------------------------------------


def scanned(rows):
    """The statistics from a scan of the table, as comparable lists."""
    return {
        "daily_revenue": series.with_revenue(series.daily_visits(rows)).collect(),
        "monthly_revenue": series.with_revenue(series.monthly_visits(rows)).collect(),
        "top_names": distribution.top_names(rows).collect(),
        "top_addresses": distribution.top_addresses(rows).collect(),
        "value_distribution": sorted(distribution.value_distribution(rows, list(rc.VALUES)).collect()),
    }


def running(spark, table):
    found = rc.running_statistics(rc.read_counts(spark, table))
    got = {k: df.collect() for k, df in found.items()}
    return got | {"value_distribution": sorted(got["value_distribution"])}


def test_running_counts_equal_a_scan(spark, tmp_path):
    rows = [(i, f"Né{i % 5}", ["a", "", None, "b"][i % 4], dt.date(2024, 1 + i % 4, 1 + i % 3), ["F", "M", None][i % 3]) for i in range(60)]
    visits = conform(spark.createDataFrame(rows, "id bigint, name string, adresse string, created_at date, sexe string"))
    table = ts.StoredTable(str(tmp_path / "t"), 8)
    ts.create_table(spark, table, visits)
    rc.record_counts(spark, table, 0)
    assert running(spark, table) == scanned(ts.read_table(spark, table))
    batches = [
        [update(1, 3, name="Ne1", adresse="c"), delete(2, 5), insert(3, 900, adresse="z")],
        [delete(4, 900), update(5, 7, sexe="X"), update(6, 10**6, name="no one")],
        [update(7, 1, name="")],
    ]
    for v, changes in enumerate(batches, 1):
        ts.apply_batch(spark, table, batch(spark, *changes), v, F.col("received_at"))
        rc.record_counts(spark, table, v)
        rc.record_counts(spark, table, v)  # repeated
        assert running(spark, table) == scanned(ts.read_table(spark, table))
        if v == 2:
            rc.compact_counts(spark, table)
            rc.compact_counts(spark, table)
            assert running(spark, table) == scanned(ts.read_table(spark, table))


def test_a_share_reads_the_named_buckets_only(spark, tmp_path):
    table = ts.StoredTable(str(tmp_path / "t"), 8)
    ts.create_table(spark, table, conform(spark.range(100).select("id", F.lit("n").alias("name"))))
    ts.apply_batch(spark, table, batch(spark, update(1, 3, name="m")), 1, F.col("received_at"))
    rc.record_counts(spark, table, 1)
    share = spark.read.parquet(f"{table.path}/counts/batch_id=1").collect()
    assert sorted((r.kind, r.key, r.n) for r in share) == [("name", "m", 1), ("name", "n", -1)]


def test_a_share_counts_the_changed_rows_only(spark, tmp_path):
    table = ts.StoredTable(str(tmp_path / "t"), 2)
    ts.create_table(spark, table, conform(spark.range(100).select("id", F.lit("n").alias("name"))))
    batches = [[update(1, 3, name="m"), delete(2, 5)], [insert(3, 5, name="k"), update(4, 500, name="x"), insert(5, 7)]]
    changed = []
    for v, rows in enumerate(batches, 1):
        ts.apply_batch(spark, table, batch(spark, *rows), v, F.col("received_at"))
        changed.append(sorted((r.id, r.name, r.weight) for r in rc.changed_rows(spark, table, v).collect()))
    assert changed[0] == [(3, "m", 1), (3, "n", -1), (5, "n", -1)]
    assert changed[1] == [(5, "k", 1), (7, "n", -1), (7, "n", 1)]  # the insert of 7 was refused


def test_counts_of_an_empty_table(spark, tmp_path):
    table = ts.StoredTable(str(tmp_path / "t"), 2)
    assert rc.read_counts(spark, table).isEmpty()
    ts.create_table(spark, table, conform(spark.createDataFrame([], "id bigint, name string")))
    rc.record_counts(spark, table, 0)
    assert all(rows == [] for rows in running(spark, table).values())


# --- metrics of a write, collation ---------------------------------------------------------------


def test_missing_fields_are_counted_while_writing(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a", None), (None, None), ("c", "d")], "name string, action string").repartition(2)
    counted = df.mapInPandas(lambda parts: (runs.add(len(p)) or p for p in parts), df.schema)
    report = quality.write_observed(counted, str(tmp_path / "w"), ["name", "action"])
    assert {r.field: r.n_missing for r in report.collect()} == {"name": 1, "action": 2}
    assert runs.value == 3 and spark.read.parquet(str(tmp_path / "w")).count() == 3
    empty = quality.write_observed(df.limit(0), str(tmp_path / "e"), ["name"])
    assert [tuple(r) for r in empty.collect()] == [("name", 0)]


def test_collated_search_and_its_differences(spark):
    rows = [(1, "Élodie N'Diaye", None), (2, "elodie", "x"), (3, None, "ÉLODIE"), (4, None, None), (5, "Straße", "50%"), (6, "élodie", "")]
    df = spark.createDataFrame(rows, "id bigint, name string, adresse string")
    found = lambda q: sorted(r.id for r in search.search_unaccented(df, q).collect())
    assert found("ELODIE") == [1, 2, 3, 6] and found("élo") == [1, 2, 3, 6] and found("%") == [5]
    assert found("") == [1, 2, 3, 5, 6]
    counts = distribution.unaccented_counts(df, "name").collect()
    assert {r.name: r.n for r in counts} == {"Élodie N'Diaye": 1, "elodie": 2, "Straße": 1}
