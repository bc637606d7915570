"""Controlling how often, and how, columns are evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are costly and used several times afterwards.

    The optimizer copies a projected expression into the filters and projections that
    use it. Columns that come out of a generator are values it has to keep.
    """
    kept = [c for c in df.columns if c not in columns]
    return unpack_once(df, F.struct(*[c.alias(name) for name, c in columns.items()]), kept)


def unpack_once(df: DataFrame, row: Column, kept: list[str]) -> DataFrame:
    """The columns in `kept` and the fields of a struct that is evaluated once per row.

    The struct is projected first, where its expressions are compiled and share their
    common parts; the generator only unpacks it.
    """
    return df.select(*kept, row.alias("_row")).select(*kept, F.inline(F.array("_row")))


def present(values: list[Column]) -> Column:
    """The distinct non-null strings among some columns, in order, as an array.

    A set difference is compiled together with the values, which a filtering lambda
    would evaluate one by one.
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))
