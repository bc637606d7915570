"""Result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(result: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Publish a result, replacing its previous version."""
    writer = result.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
