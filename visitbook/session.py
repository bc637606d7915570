"""Session settings the operators rely on, and where durable scratch data goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Sizes are left to the cluster: with adaptive execution the
# shuffle partition count is only an upper bound that Spark coalesces from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # What passes between the JVM and Python at a time; long texts make large batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory below the shared checkpoint folder of the cluster.

    Every executor must see it, so a machine-local folder is used only when the
    whole session is one local process and no folder is configured.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="visitbook-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, which may be any that Spark can reach, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def finished_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of the folders below `path` whose write is complete."""
    system, place = _folder(spark, path)
    if not system.exists(place):
        return []
    found = [f.getPath() for f in system.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [p.getName()[len(prefix) :] for p in done]


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders batch_id=N below `path` whose write is complete, in order."""
    return sorted(int(n) for n in finished_folders(spark, path, "batch_id="))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, for instance settled tables that are done with."""
    system, place = _folder(spark, path)
    system.delete(place, True)


def settle(df: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Write an intermediate result to the shared scratch folder and read it back.

    Later stages, and retries after a lost executor, start from the files; their size
    tells the optimizer how large the result really is.
    """
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
