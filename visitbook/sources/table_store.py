"""A stored table in buckets of its id, of which a batch rewrites only those it names.

    rows/bucket=K/version=V      rows of a bucket as version V left them
    heads/bucket=K/version=V     per id the last change that was applied to it
    deleted/batch_id=V           rows that version V deleted, and the changes it refused
    rejected/batch_id=V
    versions/batch_id=V          for each bucket the version that holds its rows

A version is there once its folder below `versions` is complete, which is written last; readers
take the buckets that it lists, as a partition filter, and so see whole versions only. Files are
never changed: what a version leaves alone stays in the files it was in. A batch that is repeated
after a failure overwrites its own folders, and one that was completed is not applied again.

There is one writer at a time. A table has no columns named bucket or version of its own. Choose the number of buckets so that one holds about a gigabyte;
only lists of buckets pass through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from visitbook.operators.changes import Applied, apply_checked, check_order, prepare_changes
from visitbook.operators.ingest import accepted
from visitbook.schemas import CLINIC_TIME_ZONE, PATIENTS
from visitbook.session import finished_batches, remove_folder, settle

HEADS = StructType([StructField("id", LongType(), False), StructField("last_seq", LongType())])
# Versions whose files stay when old ones are removed.
KEPT_VERSIONS = 10


class StoredTable(NamedTuple):
    path: str
    buckets: int
    schema: StructType = PATIENTS


def bucket_of(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, table: StoredTable) -> list[int]:
    """The complete versions, oldest first."""
    return finished_batches(spark, f"{table.path}/versions")


def bucket_versions(spark: SparkSession, table: StoredTable, version: int | None = None) -> list[int]:
    """For each bucket the version that holds its rows, of the last or a given version."""
    at = versions(spark, table)[-1] if version is None else version
    listed = spark.read.schema("bucket int, version bigint").parquet(f"{table.path}/versions/batch_id={at}")
    held = {r["bucket"]: r["version"] for r in listed.collect()}
    return [held[b] for b in range(table.buckets)]


def _part(
    spark: SparkSession, table: StoredTable, part: str, schema: StructType, version: int | None, buckets: list[int] | None
) -> DataFrame:
    """Rows of the listed buckets as a version has them; other buckets and versions are not read."""
    held = ",".join(map(str, bucket_versions(spark, table, version)))
    current = F.get(F.split(F.lit(held), ",").cast("array<bigint>"), F.col("bucket")) == F.col("version")
    layout = StructType([*schema, StructField("bucket", IntegerType()), StructField("version", LongType())])
    found = spark.read.schema(layout).parquet(f"{table.path}/{part}").where(current)
    if buckets is not None:
        found = found.where(F.col("bucket").isin(buckets))
    return found.drop("bucket", "version")


def read_table(
    spark: SparkSession, table: StoredTable, version: int | None = None, buckets: list[int] | None = None
) -> DataFrame:
    """The rows of the last or a given version, of all or some buckets."""
    return _part(spark, table, "rows", table.schema, version, buckets)


def read_heads(
    spark: SparkSession, table: StoredTable, buckets: list[int] | None = None, version: int | None = None
) -> DataFrame:
    """id, last_seq: the last change applied to each id that was changed, whether it is stored or not."""
    return _part(spark, table, "heads", HEADS, version, buckets)


def rows_by_id(spark: SparkSession, table: StoredTable, id: int) -> DataFrame:
    """The row of one id, from the one bucket that can hold it."""
    bucket = spark.range(1).select(bucket_of(F.lit(id).cast("bigint"), table.buckets)).first()[0]
    return read_table(spark, table, buckets=[bucket]).where(F.col("id") == id)


def _write_part(rows: DataFrame, table: StoredTable, part: str, version: int) -> None:
    """Write buckets as a version; adaptive execution sizes the files. Rows are sorted by id, so
    that a lookup skips most of a file.
    """
    (
        rows.withColumn("bucket", bucket_of(F.col("id"), table.buckets))
        .withColumn("version", F.lit(version).cast("bigint"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "version")
        .parquet(f"{table.path}/{part}")
    )


def _complete(spark: SparkSession, table: StoredTable, held: list[int], version: int) -> None:
    listed = spark.createDataFrame(list(enumerate(held)), "bucket int, version bigint").coalesce(1)
    listed.write.mode("overwrite").parquet(f"{table.path}/versions/batch_id={version}")


def create_table(spark: SparkSession, table: StoredTable, rows: DataFrame) -> None:
    """Store rows, whose ids are unique, as version 0."""
    _write_part(rows.select(*table.schema.names), table, "rows", 0)
    _write_part(spark.createDataFrame([], HEADS), table, "heads", 0)
    _complete(spark, table, [0] * table.buckets, 0)


def refuse_late(checked: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds an error to changes that are not later than the last one applied to their id."""
    met = checked.join(heads, "id", "left")
    late = F.when(F.col("seq") <= F.col("last_seq"), F.array(F.lit("seq is too late")))
    errors = F.concat("errors", F.coalesce(late, F.array().cast("array<string>")))
    return met.withColumn("errors", errors).select(*checked.columns)


def apply_batch(
    spark: SparkSession, table: StoredTable, changes: DataFrame, version: int,
    received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE,
) -> Applied:
    """Apply a batch of changes as a version of the table, which numbers batches from 1 on.

    The outcome is that of `apply_changes` for all batches one after the other, as long as each
    id's changes arrive in order; one that does not come after the last applied to its id is
    refused. Only the buckets of accepted changes are read and written. A version that is
    complete already is not applied again.
    """
    if version not in versions(spark, table):
        prepared = check_order(prepare_changes(changes, received_at, tz))
        numbered = prepared.withColumn("_bucket", bucket_of(F.col("id"), table.buckets))
        named = sorted(r[0] for r in accepted(numbered).select("_bucket").distinct().collect())
        heads = read_heads(spark, table, named)
        checked = settle(refuse_late(prepared, heads), spark, "in-time")
        applied = apply_checked(read_table(spark, table, buckets=named), checked)
        _write_part(applied.rows.select(*table.schema.names), table, "rows", version)
        latest = accepted(checked).groupBy("id").agg(F.max("seq").alias("last_seq"))
        merged = heads.unionByName(latest).groupBy("id").agg(F.max("last_seq").alias("last_seq"))
        _write_part(merged, table, "heads", version)
        applied.deleted.write.mode("overwrite").parquet(f"{table.path}/deleted/batch_id={version}")
        applied.rejected.drop("stretch").write.mode("overwrite").parquet(f"{table.path}/rejected/batch_id={version}")
        held = bucket_versions(spark, table)
        for b in named:
            held[b] = version
        _complete(spark, table, held, version)
    return Applied(
        read_table(spark, table, version),
        spark.read.parquet(f"{table.path}/deleted/batch_id={version}"),
        spark.read.parquet(f"{table.path}/rejected/batch_id={version}"),
    )


def read_outcomes(spark: SparkSession, table: StoredTable, part: str) -> DataFrame:
    """All deleted rows or refused changes (`deleted` or `rejected`) of the complete versions."""
    done = [v for v in versions(spark, table) if v > 0]
    every = spark.read.parquet(f"{table.path}/{part}")
    return every.where(F.col("batch_id").isin(done)).drop("batch_id")


def remove_old(spark: SparkSession, table: StoredTable, keep: int = KEPT_VERSIONS) -> None:
    """Remove what only versions before the last `keep` use; deleted rows and refusals stay."""
    known = versions(spark, table)
    old, kept = known[:-keep], known[-keep:]
    used = {(b, v) for version in kept for b, v in enumerate(bucket_versions(spark, table, version))}
    gone = {(b, v) for version in old for b, v in enumerate(bucket_versions(spark, table, version))} - used
    for version in old:
        remove_folder(spark, f"{table.path}/versions/batch_id={version}")
    for b, v in gone:
        for part in ("rows", "heads"):
            remove_folder(spark, f"{table.path}/{part}/bucket={b}/version={v}")
