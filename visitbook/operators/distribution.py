"""Frequencies and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from visitbook.functions.labels import bin_label
from visitbook.functions.text import fold_name, title_case
from visitbook.operators.search import UNACCENTED


def top_k(counts: DataFrame, value: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent values; equal counts in order of value."""
    return counts.orderBy(F.desc(n), F.asc(value)).limit(k)


def top_names(df: DataFrame, name: str = "name", k: int = 8) -> DataFrame:
    """Most frequent names, spellings folded, shown in title case.

    Counting is by partial aggregation, so a very frequent name costs one row per
    task. Title case is applied to the k rows that remain.
    """
    counts = (
        df.select(fold_name(F.col(name)).alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, name, k).select(title_case(F.col(name)).alias(name), "n")


def unaccented_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n): values counted without regard to case and accents, each shown by its least spelling.

    Grouping is by the collation, whose differences from folding `search_unaccented` states.
    """
    same = F.collate(F.col(value), UNACCENTED)
    counted = df.where(F.col(value).isNotNull()).groupBy(same.alias("_same")).agg(
        F.min(F.collate(F.col(value), "UTF8_BINARY")).alias(value), F.count(F.lit(1)).alias("n")
    )
    return counted.drop("_same")


def top_addresses(df: DataFrame, adresse: str = "adresse", k: int = 10) -> DataFrame:
    """Most frequent addresses as written; missing ones do not count."""
    counts = df.where(F.col(adresse).isNotNull()).groupBy(adresse).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, adresse, k)


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def value_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns from one scan; blank and zero values do not count."""

    def as_text(name: str) -> Column:
        numeric = isinstance(df.schema[name].dataType, NumericType)
        c = F.nullif(F.col(name), F.lit(0)) if numeric else F.col(name)
        return c.cast("string").alias(name)

    tall = df.select(*[as_text(c) for c in columns]).unpivot([], columns, "column", "value")
    return (
        tall.where(non_blank(F.col("value")))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, label, n) for equal-width bins from the minimum to the maximum.

    Every bin is returned, also an empty one; the maximum falls in the last bin, and a
    constant column falls in the first. The bounds reach the rows as a scalar subquery.
    """
    v = F.col(value)
    numbers = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(v.cast("double").alias(value))
    ends = numbers.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    at_ends = ends.select(F.struct("low", "high")).scalar()
    width = (at_ends["high"] - at_ends["low"]) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - at_ends["low"]) / width), F.lit(bins - 1)))
    counts = numbers.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = ends.where(F.col("low").isNotNull()).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"),
        "low",
        ((F.col("high") - F.col("low")) / bins).alias("width"),
    )
    start = F.col("low") + F.col("bin") * F.col("width")
    return edges.join(counts, "bin", "left").select(
        "bin", bin_label(start, start + F.col("width")).alias("label"), F.coalesce("n", F.lit(0)).alias("n")
    )
