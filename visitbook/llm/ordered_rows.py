"""Rows of many groups in order: keys that stand for null too, and numbered stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from visitbook.session import settle

# Row numbers are the partition's number above this many bits and the row within it below.
ROW_BITS = 33


def group_key(value: Column) -> Column:
    """A text that is never null and sorts as the value's text does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def key_value(key: Column, dtype: DataType) -> Column:
    """The value a key of `group_key` stands for."""
    return F.when(key != "", F.substr(key, F.lit(2)).cast(dtype))


def in_order(rows: DataFrame, keys: list[str], also: list[Column | str] | None = None) -> DataFrame:
    """The rows with `row`, a number that grows along the keys, written to the shared folder.

    Ranges of the keys (and of `also`, which only splits ranges further) are partitions, so a
    group of any size spans many of them. The numbers are read from the files from then on. The
    input is evaluated twice, once to find the ranges: settle what is costly before.
    """
    ranged = rows.repartitionByRange(*keys, *(also or [])).sortWithinPartitions(*keys, *(also or []))
    return settle(ranged.withColumn("row", F.monotonically_increasing_id()), rows.sparkSession, "ordered")
