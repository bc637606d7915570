"""Rules the stored tables must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def orphan_visits(visits: DataFrame, patients: DataFrame, key: str = "patient_id", id: str = "id") -> DataFrame:
    """Visits that refer to a patient who does not exist. A null reference is allowed."""
    parents = patients.select(F.col(id).alias(key))
    return visits.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def required_field_report(df: DataFrame, required: list[str]) -> DataFrame:
    """(field, n_missing) for every required column, from one pass over the table."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return missing.unpivot([], required, "field", "n_missing")


def write_observed(df: DataFrame, path: str, required: list[str], mode: str = "error") -> DataFrame:
    """Write a table and return its (field, n_missing), gathered while it is written.

    The rows pass once: the counts are metrics of the write, not a scan of their own.
    """
    seen = Observation()
    df.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).write.mode(mode).parquet(path)
    return df.sparkSession.createDataFrame(list(seen.get.items()), "field string, n_missing bigint")
