"""The audit log in batch: ranges, order, daily digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitbook.functions.fields import to_day
from visitbook.functions.labels import digest_header, log_line


def log_range(log: DataFrame, day: str, ts: str = "timestamp") -> DataFrame:
    """Events from the start of `day` to the start of the next one, the latter excluded.

    The bounds are constants of the column's own type, so the filter reaches the scan;
    a day-partitioned log is pruned to one partition as well.
    """
    dtype = log.schema[ts].dataType
    start = F.lit(day).cast("date")
    inside = (F.col(ts) >= start.cast(dtype)) & (F.col(ts) < F.date_add(start, 1).cast(dtype))
    if "log_date" in log.columns:
        inside = inside & (F.col("log_date") == start)
    return log.where(inside)


def log_order(log: DataFrame, ts: str = "timestamp", id: str = "id") -> DataFrame:
    return log.orderBy(ts, id)


def daily_digest(log: DataFrame, ts: str = "timestamp", id: str = "id") -> DataFrame:
    """The lines of every day's report: (log_date, ts, id, line).

    The header of a day has no timestamp and sorts before its events. A day stays a
    set of rows, never one string, because it may hold a large part of the log.
    """
    dated = log.withColumn("log_date", to_day(F.col(ts)))
    lines = dated.select(
        "log_date",
        F.col(ts).alias("ts"),
        F.col(id).alias("id"),
        log_line(F.col("user_type"), F.col("action"), F.col("details")).alias("line"),
    )
    headers = dated.select("log_date").distinct().select(
        "log_date",
        F.lit(None).cast(log.schema[ts].dataType).alias("ts"),
        F.lit(None).cast(log.schema[id].dataType).alias("id"),
        digest_header(F.col("log_date")).alias("line"),
    )
    return headers.unionByName(lines)


def write_digest(digest: DataFrame, path: str) -> None:
    """One folder of text per day, ordered by file name and then by line.

    Range partitioning on the full order splits a very busy day over several files.
    """
    order = [F.asc("log_date"), F.asc_nulls_first("ts"), F.asc_nulls_first("id")]
    gap = F.when(F.col("ts").isNull(), F.lit("\n")).otherwise(F.lit(""))
    (
        digest.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("log_date", F.concat("line", gap).alias("value"))
        .write.mode("overwrite")
        .partitionBy("log_date")
        .text(path)
    )
