"""Visits laid out for their two usual questions: a span of time, and all visits of a name.

The table is partitioned by month and, within a month, bucketed and sorted by name. A condition on
the day reads the months it touches; a join or a count by name needs no exchange of the visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.functions.fields import to_day, to_month
from visitbook.operators.history import history_counts
from visitbook.session import settle

# Buckets of names in every month; about as many as a month has gigabytes, times the months read at once.
NAME_BUCKETS = 32


def store_visits(
    visits: DataFrame, table: str, path: str, name: str = "name", created_at: str = "created_at", buckets: int = NAME_BUCKETS
) -> None:
    """Write the visits as a table of the catalog at `path`, which all executors share.

    Visits without a date are a partition of their own. A month's bucket is written by one task, or
    by several where adaptive execution splits a large one, so there are few files.
    """
    (
        visits.withColumn("month", to_month(F.col(created_at)))
        .withColumn("_bucket", F.pmod(F.hash(name), F.lit(buckets)))
        .hint("rebalance", "month", "_bucket")
        .drop("_bucket")
        .write.partitionBy("month")
        .bucketBy(buckets, name)
        .sortBy(name)
        .option("path", path)
        .saveAsTable(table)
    )


def between(visits: DataFrame, first: str, last: str, created_at: str = "created_at") -> DataFrame:
    """Visits of the days from `first` to `last`; only months that the span touches are read."""
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    day = to_day(F.col(created_at))
    months = (F.col("month") >= F.trunc(start, "MM")) & (F.col("month") <= F.trunc(end, "MM"))
    return visits.where(months & (day >= start) & (day <= end))


def history_in_buckets(spark: SparkSession, table: str, ids: DataFrame, id: str = "id", name: str = "name") -> DataFrame:
    """`visit_history` over a laid-out table: the visits are neither exchanged for the counts nor
    for the join, which meets them bucket by bucket with the few wanted names.

    A name is in one bucket; one so frequent that its bucket outgrows a task is better served by
    `history.visit_history`, which can split it.
    """
    visits = spark.table(table)
    persons = settle(visits.join(ids.select(id).distinct(), id, "left_semi").select(name).distinct(), spark, "persons")
    counts = history_counts(visits, name).join(persons, name, "left_semi")
    return visits.drop("month").join(counts.hint("merge"), name)
