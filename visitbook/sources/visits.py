"""Visit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.functions.fields import to_day
from visitbook.functions.text import strip_accents, strip_ws
from visitbook.schemas import PATIENTS


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Scan the visit table with its declared schema and normalise it.

    Nothing is inferred, and columns the caller does not use are not read.
    """
    return normalize_visits(spark.read.schema(PATIENTS).parquet(path))


def normalize_visits(visits: DataFrame, name: str = "name", created_at: str = "created_at") -> DataFrame:
    """Dates as dates; names without surrounding whitespace and accents."""
    return visits.withColumns(
        {created_at: to_day(F.col(created_at)), name: strip_accents(strip_ws(F.col(name)))}
    )
