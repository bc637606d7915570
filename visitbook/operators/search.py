"""Finding visits: text search, lookup by id, newest first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitbook.columns import present
from visitbook.schemas import PAGE_SIZE

# The collation that compares letters without case and accents.
UNACCENTED = "UNICODE_CI_AI"


def like_pattern(query: str) -> str:
    """Substring pattern; % and _ in the query stay wildcards, a backslash quotes the next character."""
    quoted = re.sub(r"(?s)\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], query)
    return "%" + quoted + "%"


def matches(query: str, columns: list[str]) -> Column:
    pattern = like_pattern(query)
    found = F.col(columns[0]).ilike(pattern)
    for c in columns[1:]:
        found = found | F.col(c).ilike(pattern)
    return found


def search(df: DataFrame, query: str, columns: tuple[str, ...] = ("name", "adresse")) -> DataFrame:
    """Rows where any of the columns holds the query, ignoring case."""
    return df.where(matches(query, list(columns)))


def search_many(
    df: DataFrame, queries: list[str], columns: tuple[str, ...] = ("name", "adresse")
) -> DataFrame:
    """Answer several queries in one scan: one output row per row and distinct matching query (column q).

    The patterns are constants compiled once per task; there is no join.
    """
    hits = present([F.when(matches(q, list(columns)), F.lit(q)) for q in queries])
    return df.withColumn("q", F.explode(hits))


def search_unaccented(df: DataFrame, query: str, columns: tuple[str, ...] = ("name", "adresse")) -> DataFrame:
    """Rows where any of the columns holds the query, ignoring case and accents.

    The comparison is that of the collation: % and _ are ordinary characters, signs it ignores
    (control characters, for instance) may be missing on either side, and letters count as equal
    where the collation says so (ß and ss), which folding by decomposition does not.
    """
    found = F.lit(False)
    for c in columns:
        held = F.contains(F.collate(F.col(c), UNACCENTED), F.collate(F.lit(query), UNACCENTED))
        found = found | F.coalesce(held, F.lit(False))
    return df.where(found)


def by_id(df: DataFrame, key: int, id: str = "id") -> DataFrame:
    return df.where(F.col(id) == key)


def by_ids(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is listed; `ids` may repeat ids."""
    return df.join(ids.select(id), id, "left_semi")


def page_size(requested: object) -> int:
    """Page size from user input: anything but a positive number means the default."""
    found = re.match(r"\s*([+-]?\d+)", str(requested))
    n = int(found.group(1)) if found else 0
    return n if n > 0 else PAGE_SIZE


def latest(
    df: DataFrame, size: object = PAGE_SIZE, created_at: str = "created_at", id: str = "id"
) -> DataFrame:
    """Newest rows first. A missing date sorts as 1970-01-01; equal dates sort by id."""
    dated = F.coalesce(F.col(created_at), F.lit("1970-01-01").cast(df.schema[created_at].dataType))
    return df.orderBy(dated.desc(), F.col(id).asc()).limit(page_size(size))
