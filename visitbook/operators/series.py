"""Visits and revenue per day and per month, without holes in the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitbook.functions.fields import to_day, to_month
from visitbook.schemas import VISIT_FEE


def daily_visits(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """(day, n) for every day between the first and the last visit."""
    return gap_fill(daily_counts(df, ts), "day", "n", "day")


def daily_counts(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """(day, n) for the days that have visits."""
    return _counts(df, to_day(F.col(ts)), "day")


def monthly_visits(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """(month, n) for every month between the first and the last visit, both included."""
    return gap_fill(_counts(df, to_month(F.col(ts)), "month"), "month", "n", "month")


def _counts(df: DataFrame, bucket, name: str) -> DataFrame:
    dated = df.select(bucket.alias(name)).where(F.col(name).isNotNull())
    return dated.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def gap_fill(counts: DataFrame, date: str, value: str, step: str) -> DataFrame:
    """Add the missing dates of an aggregated series with value 0.

    Each row emits the dates up to its successor, so the facts behind `counts` are
    scanned once and nothing is joined. The window sees at most one row per calendar
    day, whatever the size of the facts.
    """
    following = F.lead(date).over(Window.orderBy(date))
    last = F.date_sub("_next", 1) if step == "day" else F.add_months("_next", -1)
    span = F.sequence(F.col("_at"), F.coalesce(last, F.col("_at")), F.expr(f"interval 1 {step}"))
    known = counts.select(F.col(date).alias("_at"), value, following.alias("_next"))
    filled = known.select("_at", value, F.explode(span).alias(date))
    return filled.select(
        date, F.when(F.col(date) == F.col("_at"), F.col(value)).otherwise(F.lit(0)).alias(value)
    )


def with_revenue(series: DataFrame, fee: int = VISIT_FEE) -> DataFrame:
    """Flat fee per visit."""
    return series.withColumn("revenue", F.col("n") * F.lit(fee).cast("bigint"))


def bounds(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """(first_day, last_day); both null for a table without dates."""
    day = to_day(F.col(ts))
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
