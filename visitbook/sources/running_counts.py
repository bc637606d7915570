"""Statistics of a stored table, kept up to date by what each version changes.

    counts/batch_id=V        kind, key, n: what version V added to and took from the counts
    counts_until/batch_id=V  the sums of all versions up to V

Counts of days, names and values add up, so a version's share is the count over the rows of the
ids it changed, after it less before it. Only the buckets it rewrote are read, and their other rows
are not counted. The statistics are made of the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.functions.fields import to_day, to_month
from visitbook.functions.text import fold_name, title_case
from visitbook.operators.distribution import non_blank, top_k
from visitbook.operators.series import gap_fill, with_revenue
from visitbook.session import finished_batches, settle
from visitbook.sources.table_store import StoredTable, bucket_versions, read_heads, read_table, versions

# Columns whose values are counted as they are.
VALUES = ("adresse", "sexe", "groupe_sanguin")
SCHEMA = "kind string, key string, n bigint"


def count_rows(visits: DataFrame, weight: Column | None = None) -> DataFrame:
    """(kind, key, n): visits per day, per folded name and per value of some columns.

    Each kind is an aggregation of its own, which reads its column only; keys become text when
    they are counted. With a weight, the sum of the weights.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)

    def one(kind: str, key: Column) -> DataFrame:
        counted = visits.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(n.alias("n"))
        return counted.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "n")

    found = one("day", to_day(F.col("created_at"))).unionByName(one("name", fold_name(F.col("name"))))
    for c in VALUES:
        found = found.unionByName(one(c, F.col(c)))
    return found


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n != 0")


def changed_rows(spark: SparkSession, table: StoredTable, version: int) -> DataFrame:
    """The counted columns of the rows whose id a version changed: after it with weight 1, before
    it with weight -1. Ids are told by their last change, which moved on; one that is null always is.
    """
    named = [b for b, v in enumerate(bucket_versions(spark, table, version)) if v == version]
    earlier = max(v for v in versions(spark, table) if v < version)
    heads = read_heads(spark, table, named, version)
    moved = heads.join(read_heads(spark, table, named, earlier), ["id", "last_seq"], "left_anti").select("id")
    moved = settle(moved, spark, "moved").alias("m")

    def rows(at: int, weight: int) -> DataFrame:
        held = read_table(spark, table, at, named).alias("r").join(moved, F.expr("r.id <=> m.id"), "left_semi")
        return held.select("id", "created_at", "name", *VALUES, F.lit(weight).alias("weight"))

    return rows(version, 1).unionByName(rows(earlier, -1))


def record_counts(spark: SparkSession, table: StoredTable, version: int) -> None:
    """Store what a complete version changes; repeated, it writes the same again."""
    if version == 0:
        share = count_rows(read_table(spark, table, 0))
    else:
        share = count_rows(settle(changed_rows(spark, table, version), spark, "changed"), F.col("weight")).where("n != 0")
    share.write.mode("overwrite").parquet(f"{table.path}/counts/batch_id={version}")


def read_counts(spark: SparkSession, table: StoredTable) -> DataFrame:
    """(kind, key, n) as of the last version whose share is recorded."""
    sums = finished_batches(spark, f"{table.path}/counts_until")
    last = sums[-1] if sums else -1
    folders = [f"{table.path}/counts/batch_id={v}" for v in finished_batches(spark, f"{table.path}/counts") if v > last]
    if sums:
        folders.append(f"{table.path}/counts_until/batch_id={last}")
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return _summed(spark.read.schema(SCHEMA).parquet(*folders))


def compact_counts(spark: SparkSession, table: StoredTable) -> None:
    """Sum the shares recorded so far, so that reading stays cheap after many versions."""
    recorded = finished_batches(spark, f"{table.path}/counts")
    done = finished_batches(spark, f"{table.path}/counts_until")
    if recorded and (not done or recorded[-1] > done[-1]):
        read_counts(spark, table).write.mode("overwrite").parquet(f"{table.path}/counts_until/batch_id={recorded[-1]}")


def running_statistics(counts: DataFrame) -> dict[str, DataFrame]:
    """The statistics that a scan of the table would give: daily and monthly revenue, the most
    frequent names and addresses, and the distribution of values.
    """
    of = lambda kind: counts.where(F.col("kind") == kind)
    days = of("day").select(F.col("key").cast("date").alias("day"), "n")
    months = days.groupBy(to_month(F.col("day")).alias("month")).agg(F.sum("n").alias("n"))
    values = counts.where(F.col("kind").isin(*VALUES) & non_blank(F.col("key")))
    return {
        "daily_revenue": with_revenue(gap_fill(days, "day", "n", "day")),
        "monthly_revenue": with_revenue(gap_fill(months, "month", "n", "month")),
        "top_names": top_k(of("name").select(F.col("key").alias("name"), "n"), "name", 8).select(title_case(F.col("name")).alias("name"), "n"),
        "top_addresses": top_k(of("adresse").select(F.col("key").alias("adresse"), "n"), "adresse", 10),
        "value_distribution": values.select(F.col("kind").alias("column"), F.col("key").alias("value"), "n"),
    }
