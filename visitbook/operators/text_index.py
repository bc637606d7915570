"""Substring search through a table of trigrams.

    postings/part=K   gram, id: every row that holds the trigram, ignoring case
    counts            gram, n: in how many rows

A query names the rarest of its trigrams; the rows listed there are compared with the query
itself, so the result is that of `search`. Trigrams are taken between wildcards. Queries without
three letters in a row have none and are answered by a scan, which joins on what they do have.
Many queries are a table; every join is by equality.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.operators.search import search
from visitbook.session import settle
from visitbook.sources.table_store import StoredTable, bucket_of, read_table

COLUMNS = ("name", "adresse")
GRAM = 3
# Folders the trigrams are dealt into; a lookup reads one.
PARTS = 64
# Stands between the literal runs of a pattern.
GAP = "\x00"
# What a query is compared by.
TESTED = ("pattern", "enough", "head", "tail")


class TextIndex(NamedTuple):
    path: str
    parts: int = PARTS
    columns: tuple[str, ...] = COLUMNS
    id: str = "id"


def _grams(text: Column, n: int = GRAM, of: str = ".") -> Column:
    """All runs of n characters, overlapping ones too, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({of}{{{n}}}))"), 1)


def _row_grams(columns: tuple[str, ...], *sizes: int) -> Column:
    """Distinct lower-cased runs in any of the columns."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(_grams(F.lower(F.col(c)), n), none) for c in columns for n in sizes]
    return F.array_distinct(F.concat(*found))


def pattern_of(query: Column) -> Column:
    """The substring pattern of a query: % and _ stay wildcards, a backslash quotes what follows."""
    return F.concat(F.lit("%"), F.regexp_replace(query, r"(?s)(\\[%_\\])|\\(.)", "$1$2"), F.lit("%"))


def _literals(pattern: Column) -> Column:
    """The lower-cased characters a pattern names, wildcards as gaps."""
    tokens = F.regexp_extract_all(F.lower(pattern), F.lit(r"(?s)\\.|."), 0)
    plain = F.transform(tokens, lambda t: F.when(t.isin("%", "_"), F.lit(GAP)).otherwise(F.right(t, F.lit(1))))
    return F.array_join(plain, "")


def _part_of(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def write_index(rows: DataFrame, index: TextIndex) -> None:
    """Index the rows' columns; `id` tells them apart. A trigram of very many rows spans files.

    Files are sorted by trigram, so a lookup skips most of a folder. Rows are dealt out first: a row
    group of short texts is one task's, and holds very many.
    """
    dealt = rows.select(index.id, *index.columns).repartition(index.id)
    pairs = dealt.select(index.id, F.explode(_row_grams(index.columns, GRAM)).alias("gram"))
    (
        pairs.withColumn("part", _part_of(F.col("gram"), index.parts))
        .hint("rebalance", "part")
        .sortWithinPartitions("part", "gram", index.id)
        .write.partitionBy("part")
        .parquet(f"{index.path}/postings")
    )
    listed = rows.sparkSession.read.schema("gram string").parquet(f"{index.path}/postings")
    listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{index.path}/counts")


def read_postings(spark: SparkSession, index: TextIndex, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"gram string, {index.id} {id_type}, part int").parquet(f"{index.path}/postings")


def read_counts(spark: SparkSession, index: TextIndex) -> DataFrame:
    return spark.read.schema("gram string, n bigint").parquet(f"{index.path}/counts")


def _rarest(spark: SparkSession, index: TextIndex, query: str) -> tuple[str, int] | None:
    """The rarest trigram of a query and its folder; None for a query without one.

    No more than the query's own trigrams reach the driver.
    """
    grams = F.array_distinct(_grams(_literals(pattern_of(F.lit(query))), GRAM, f"[^{GAP}]"))
    asked = spark.range(1).select(F.explode(grams).alias("gram"))
    known = read_counts(spark, index)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    best = asked.join(known, "gram", "left").agg(F.min(F.struct(n.alias("n"), "gram"))["gram"].alias("gram"))
    gram, part = best.select("gram", _part_of(F.col("gram"), index.parts)).first()
    return None if gram is None else (gram, part)


def candidates(spark: SparkSession, index: TextIndex, query: str, id_type: str = "bigint") -> DataFrame | None:
    """Ids of the rows that hold the query's rarest trigram; None if it has none."""
    found = _rarest(spark, index, query)
    if found is None:
        return None
    gram, part = found
    return read_postings(spark, index, id_type).where((F.col("part") == part) & (F.col("gram") == gram)).select(index.id)


def search_indexed(rows: DataFrame, index: TextIndex, query: str) -> DataFrame:
    """`search` over the rows that the postings list; the rows must be those indexed."""
    listed = candidates(rows.sparkSession, index, query, rows.schema[index.id].dataType.simpleString())
    near = rows if listed is None else rows.join(listed, index.id, "left_semi")
    return search(near, query, index.columns)


def search_stored(spark: SparkSession, table: StoredTable, index: TextIndex, query: str) -> DataFrame:
    """`search` over a stored table, of which only the buckets with listed rows are read.

    The list of buckets passes through the driver, which has a list of all buckets anyway.
    """
    listed = candidates(spark, index, query)
    if listed is None:
        return search(read_table(spark, table), query, index.columns)
    named = listed.select(bucket_of(F.col(index.id), table.buckets)).distinct().collect()
    return search_indexed(read_table(spark, table, buckets=sorted(r[0] for r in named)), index, query)


# A pattern whose only wildcards are the outer two and at most one % between them.
_ONE_GAP = r"(?s)^%((?:[^%_\\]++|\\.)*+)(?:%((?:[^%_\\]++|\\.)*+))?%$"


def parsed_queries(queries: DataFrame, q: str = "q") -> DataFrame:
    """Distinct queries with their lower-cased pattern, their trigrams, and the run that a short one
    is known by.

    A text that holds a query holds `head` and, behind its first place, `tail`; where `enough`, the
    converse is true as well. Both may be empty.
    """
    pattern = F.lower(pattern_of(F.col("q")))
    asked = queries.select(F.col(q).alias("q")).where("q IS NOT NULL").distinct().withColumn("pattern", pattern)
    runs = F.array_remove(F.split(F.col("literals"), GAP), "")
    enough = F.col("pattern").rlike(_ONE_GAP)
    named = compute_once(asked, {"literals": _literals(F.col("pattern"))}).withColumn("enough", enough).withColumn("_runs", runs)
    inside = f"[^{GAP}]"
    first = lambda n: F.get(_grams(F.col("literals"), n, inside), F.lit(0))
    plain = lambda k: F.regexp_replace(F.regexp_extract("pattern", _ONE_GAP, k), r"(?s)\\(.)", "$1")
    last = F.when(F.size("_runs") > 1, F.element_at("_runs", -1))
    return named.select(
        "q", "pattern", F.array_distinct(_grams(F.col("literals"), GRAM, inside)).alias("grams"),
        F.coalesce(first(2), first(1), F.lit("")).alias("short"), "enough",
        F.when(F.col("enough"), plain(1)).otherwise(F.coalesce(F.get("_runs", F.lit(0)), F.lit(""))).alias("head"),
        F.when(F.col("enough"), plain(2)).otherwise(F.coalesce(last, F.lit(""))).alias("tail"),
    )


def _holds(low: Column) -> Column:
    """Whether a lower-cased text holds the query beside it: ILIKE, which builds a matcher for every
    row when patterns are columns, only where plain comparisons do not settle it.
    """
    head, tail = F.col("head"), F.col("tail")
    behind = F.substr(low, F.position(head, low) + F.char_length(head))
    near = F.contains(low, head) & ((tail == "") | F.contains(behind, tail))
    return F.coalesce(near & (F.col("enough") | F.like(low, F.col("pattern"))), F.lit(False))


def search_queries(rows: DataFrame, index: TextIndex, queries: DataFrame, q: str = "q") -> DataFrame:
    """Every row with every distinct query of a table that it holds, as column q.

    Queries are matched to rows by their rarest trigram and by equality, then compared. Null
    queries match nothing. Those under three letters in a row are joined with the rows' single
    and double letters, taken in a scan; one without any letter meets every row. The postings that
    are asked for meet their rows first and the queries last, so what many queries share is
    shuffled once, and pairs are compared where they come about.
    """
    spark = rows.sparkSession
    id_type = rows.schema[index.id].dataType.simpleString()
    asked = settle(parsed_queries(queries, q), spark, "queries")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    rarest = (
        asked.select("q", *TESTED, F.explode("grams").alias("gram"))
        .join(read_counts(spark, index), "gram", "left")
        .groupBy("q", *TESTED).agg(F.min(F.struct(n.alias("n"), "gram"))["gram"].alias("gram"))
        .withColumn("part", _part_of(F.col("gram"), index.parts))
    )
    rarest = settle(rarest, spark, "rarest")
    wanted = rarest.select("part", "gram").distinct()
    listed = read_postings(spark, index, id_type).join(wanted, ["part", "gram"], "left_semi").select(index.id, "gram")
    lows = {f"_low_{c}": F.lower(F.col(c)) for c in index.columns}
    by_gram = rows.join(listed, index.id).withColumns(lows).join(rarest.drop("part"), "gram")

    short = asked.where(F.size("grams") == 0).select("q", *TESTED, F.col("short").alias("_run"))
    runs = F.concat(F.array(F.lit("")), _row_grams(index.columns, 1, 2))
    dealt = rows.repartition(index.id).withColumns(lows)
    by_run = dealt.withColumn("_run", F.explode(runs)).join(short, "_run")

    shown, found = [*rows.columns, "q"], F.lit(False)
    for c in lows:
        found = found | _holds(F.col(c))
    return by_gram.where(found).select(*shown).unionByName(by_run.where(found).select(*shown))
