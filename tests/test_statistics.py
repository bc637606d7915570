from __future__ import annotations

import datetime as dt

from conftest import SF, plan

from visitbook.operators import distribution, series
from visitbook.plans import stand_ins
from visitbook.plans.requests import statistics


def visits(spark, days):
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, created_at date")


D = dt.date


def test_daily_and_monthly(spark):
    df = visits(spark, [D(2024, 1, 30), D(2024, 1, 30), D(2024, 2, 2), None])
    days = [tuple(r) for r in series.with_revenue(series.daily_visits(df)).orderBy("day").collect()]
    assert days == [
        (D(2024, 1, 30), 2, 20000), (D(2024, 1, 31), 0, 0), (D(2024, 2, 1), 0, 0), (D(2024, 2, 2), 1, 10000)
    ]
    months = [tuple(r) for r in series.monthly_visits(df).orderBy("month").collect()]
    assert months == [(D(2024, 1, 1), 2), (D(2024, 2, 1), 1)]


def test_months_with_gap(spark):
    df = visits(spark, [D(2023, 11, 30), D(2024, 2, 29)])
    assert [r.n for r in series.monthly_visits(df).orderBy("month").collect()] == [1, 0, 0, 1]


def test_empty_series(spark):
    df = visits(spark, [None])
    assert series.daily_visits(df).collect() == []
    assert series.monthly_visits(df).collect() == []
    assert tuple(series.bounds(df).first()) == (None, None)


def test_gap_fill_keeps_the_sum(spark):
    orders = stand_ins.table(spark, SF, "orders")
    filled = series.daily_visits(orders, "o_orderdate")
    rows = filled.collect()
    days = [r.day for r in rows]
    assert len(rows) == (max(days) - min(days)).days + 1 == len(set(days))
    assert sum(r.n for r in rows) == orders.count()


def test_daily_plan_scans_once_and_reads_one_column(spark):
    text = plan(series.with_revenue(series.daily_visits(stand_ins.table(spark, SF, "orders"), "o_orderdate")))
    assert text.count("ReadSchema") == 1
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text
    assert "Join" not in text


def test_top_names(spark):
    names = [" Élodie N'A ", "elodie n'a", "jean-paul", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [tuple(r) for r in distribution.top_names(df).collect()] == [("Elodie N'A", 2), ("Jean-Paul", 1)]


def test_top_addresses_are_case_sensitive_and_ordered(spark):
    values = ["b", "B", "a", "a", None] + [f"x{i:02d}" for i in range(12)]
    df = spark.createDataFrame([(v,) for v in values], "adresse string")
    rows = [tuple(r) for r in distribution.top_addresses(df).collect()]
    assert rows[0] == ("a", 2) and rows[1] == ("B", 1) and len(rows) == 10


def test_value_distribution(spark):
    df = spark.createDataFrame(
        [("x", "F", 0), ("x", "", 3), (None, "M", 3)], "adresse string, sexe string, visits int"
    )
    got = distribution.value_distribution(df, ["adresse", "sexe", "visits"])
    assert sorted(tuple(r) for r in got.collect()) == [
        ("adresse", "x", 2), ("sexe", "F", 1), ("sexe", "M", 1), ("visits", "3", 2)
    ]


def test_value_distribution_scans_once(spark):
    orders = stand_ins.table(spark, SF, "orders")
    text = plan(distribution.value_distribution(orders, ["o_orderstatus", "o_orderpriority"]))
    assert text.count("ReadSchema") == 1
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text


def hist(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [tuple(r) for r in distribution.histogram(df, "v").orderBy("bin").collect()]


def test_histogram(spark):
    rows = hist(spark, [float(i) for i in range(11)] + [None, float("nan")])
    assert [r[2] for r in rows] == [1] * 9 + [2]
    assert rows[0][1] == "0.0 - 1.0" and rows[9][1] == "9.0 - 10.0"


def test_histogram_of_a_constant_and_of_nothing(spark):
    assert [r[2] for r in hist(spark, [4.0, 4.0, 4.0])] == [3] + [0] * 9
    assert hist(spark, [None]) == []


def test_histogram_counts_every_value(spark):
    events = stand_ins.table(spark, SF, "events")
    assert sum(r.n for r in distribution.histogram(events, "value").collect()) == events.count()


def test_statistics_request(spark):
    df = spark.createDataFrame([("Ana", D(2024, 1, 1)), ("ana", D(2024, 1, 3))], "name string, created_at date")
    got = statistics(df)
    assert got["daily_revenue"].count() == 3
    assert tuple(got["top_names"].first()) == ("Ana", 2)
