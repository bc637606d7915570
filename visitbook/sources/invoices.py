"""Invoice documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from visitbook.columns import unpack_once
from visitbook.schemas import INVOICE


def read_invoices(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one per line, with the text of those that do not parse."""
    schema = StructType([*INVOICE.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).json(path)


def parse_invoices(df: DataFrame, json: Column, *keep: str) -> DataFrame:
    """Documents held as JSON text in a column, next to the columns in `keep`.

    Each text is parsed once, however many of its fields are used.
    """
    return unpack_once(df, F.from_json(json, INVOICE), list(keep))
