"""Streaming jobs.

Each takes a streaming DataFrame, an output path and a checkpoint path, and returns a
started query. Both paths belong in storage all executors share. The default trigger
processes what is available and stops; pass `trigger` for a long-running job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from visitbook.functions.fields import to_day
from visitbook.operators.audit import daily_digest, write_digest
from visitbook.operators.changes import judge_changes, notifications
from visitbook.operators.series import daily_counts, gap_fill, with_revenue
from visitbook.session import finished_batches, remove_folder, settle
from visitbook.sources.logs import read_log, write_log
from visitbook.sources.running_counts import record_counts
from visitbook.sources.table_store import StoredTable, apply_batch

# Published versions of the daily series that stay readable.
KEPT_VERSIONS = 10


def _triggered(writer: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    return writer.trigger(**(trigger or {"availableNow": True}))


def stream_log(
    events: DataFrame, path: str, checkpoint: str, ts: str = "timestamp", trigger: dict | None = None
) -> StreamingQuery:
    """Append events to the day-partitioned log, each exactly once; read it with `read_log`.

    Every trigger is written like a batch, with few files per day, into a folder of its own.
    A trigger that is repeated after a failure overwrites its folder.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        write_log(batch, f"{path}/batch_id={batch_id}", ts, mode="overwrite")

    writer = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).start()


def stream_daily_visits(
    visits: DataFrame, path: str, checkpoint: str, ts: str = "created_at", trigger: dict | None = None
) -> StreamingQuery:
    """Keep the number of visits per day up to date; read it with `read_daily_series`.

    The state is one count per calendar day, so no watermark is needed to bound it and
    a visit that arrives late still counts. Each trigger publishes the whole series as a
    version of its own, and versions older than KEPT_VERSIONS triggers are removed, so a
    reader that has planned on one keeps it meanwhile.
    """

    def publish(series: DataFrame, batch_id: int) -> None:
        series.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        for old in finished_batches(series.sparkSession, path):
            if old <= batch_id - KEPT_VERSIONS:
                remove_folder(series.sparkSession, f"{path}/batch_id={old}")

    writer = (
        daily_counts(visits, ts)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def read_daily_series(spark: SparkSession, path: str) -> DataFrame:
    """(day, n, revenue) of the last finished version, gaps filled; no rows before the first."""
    schema, finished = "day date, n bigint", finished_batches(spark, path)
    if finished:
        counts = spark.read.schema(schema).parquet(f"{path}/batch_id={finished[-1]}")
    else:
        counts = spark.createDataFrame([], schema)
    return with_revenue(gap_fill(counts, "day", "n", "day"))


# How long after the end of a day its visits may still arrive.
DELAY = "1 day"


def _closing_days(times: DataFrame, ts: str, delay: str) -> DataFrame:
    """(day, n) of each day, once, when the watermark has passed its end; then its state goes."""
    timed = times.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "n")


def stream_closed_days(
    visits: DataFrame, path: str, checkpoint: str, ts: str = "created_at", delay: str = DELAY, trigger: dict | None = None
) -> tuple[StreamingQuery, StreamingQuery]:
    """Publish each day's number of visits once, when it is closed: `read_closed_series`.

    Only open days are state. A visit that comes after its day was closed changes nothing that
    was published, but is not lost from sight: a second query without state counts all visits as
    they arrive, and `late_visits` tells what the first one did not.
    """

    def publish(part: str):
        return lambda days, batch_id: days.write.mode("overwrite").parquet(f"{path}/{part}/batch_id={batch_id}")

    closed = _closing_days(visits, ts, delay).writeStream.outputMode("append").foreachBatch(publish("closed"))
    arrivals = visits.select(to_day(F.col(ts)).alias("day"))

    def count(days: DataFrame, batch_id: int) -> None:
        publish("seen")(days.groupBy("day").agg(F.count(F.lit(1)).alias("n")), batch_id)

    seen = arrivals.writeStream.outputMode("append").foreachBatch(count)
    return tuple(
        _triggered(writer.option("checkpointLocation", f"{checkpoint}/{name}"), trigger).start()
        for name, writer in (("closed", closed), ("seen", seen))
    )


def _published(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(day, n) of the complete folders; several rows of a day that arrived in several triggers."""
    schema, done = "day date, n bigint", finished_batches(spark, f"{path}/{part}")
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{part}/batch_id={b}" for b in done])


def read_closed_series(spark: SparkSession, path: str) -> DataFrame:
    """(day, n, revenue) of the closed days, gaps filled; a published day never changes."""
    return with_revenue(gap_fill(_published(spark, path, "closed"), "day", "n", "day"))


def late_visits(spark: SparkSession, path: str) -> DataFrame:
    """(day, n): visits that came after their day was closed, once both queries are done with them."""
    closed, seen = _published(spark, path, "closed"), _published(spark, path, "seen")
    last = closed.agg(F.max("day")).scalar()
    known = seen.where(F.col("day") <= last).unionByName(closed.withColumn("n", -F.col("n")))
    return known.groupBy("day").agg(F.sum("n").alias("n")).where("n > 0")


def stream_digest(
    spark: SparkSession, log: str, path: str, checkpoint: str, ts: str = "timestamp", delay: str = DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the digest of each day once, when the watermark closes it, from a log of `stream_log`.

    The stream reads the stored log's times and nothing else; a closed day's events are taken
    from its partition, so no events are state, and each digest is range-partitioned. Events that
    come later are in the log, but not in the digest. `read_digests` reads them.
    """
    times = spark.readStream.schema(f"`{ts}` timestamp_ntz").parquet(log)

    def write(days: DataFrame, batch_id: int) -> None:
        session = days.sparkSession
        closed = settle(days.select(F.col("day").alias("log_date")), session, "closed-days")
        if closed.isEmpty():
            return
        events = read_log(session, log).join(closed, "log_date", "left_semi").drop("log_date")
        write_digest(daily_digest(events, ts), f"{path}/batch_id={batch_id}")

    writer = _closing_days(times, ts, delay).writeStream.outputMode("append").foreachBatch(write)
    return _triggered(writer.option("checkpointLocation", checkpoint), trigger).start()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(log_date, line) of all complete digests."""
    done = finished_batches(spark, path)
    if not done:
        return spark.createDataFrame([], "log_date date, line string")
    folders = [f"{path}/batch_id={b}" for b in done]
    lines = spark.read.option("basePath", path).schema("value string, batch_id bigint, log_date date").text(folders)
    return lines.where("value != ''").select("log_date", F.col("value").alias("line"))


def stream_notifications(
    changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the notifications of a change stream, each exactly once. No state is kept.

    The submitted changes are checked row by row first; refused ones are not announced.
    """
    writer = (
        notifications(judge_changes(changes))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def stream_changes(
    changes: DataFrame, table: StoredTable, checkpoint: str, received_at: Column | None = None,
    trigger: dict | None = None, count: bool = False,
) -> StreamingQuery:
    """Apply a stream of changes to a stored table, each trigger as one version, exactly once.

    Between triggers the table keeps, next to its rows, the last change of every id, so a change
    that comes too late or twice is refused. A trigger that is repeated finds its version
    complete, or writes it anew. A table belongs to one checkpoint, whose triggers number its
    versions. With `count`, the table's running counts follow every version.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch.sparkSession, table, batch, batch_id + 1, received_at)
        if count:
            record_counts(batch.sparkSession, table, batch_id + 1)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).start()
