"""Substring search through trigrams, for one query and for tables of queries."""

from __future__ import annotations

import re

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from visitbook.operators import search
from visitbook.operators import text_index as ti
from visitbook.plans import stand_ins
from visitbook.plans.requests import conform
from visitbook.sources import table_store as ts

ROWS = [
    (1, "Ana Diallo", "Rue X_Y 1"), (2, "bob", None), (3, None, "ANANAS 50%"), (4, None, None), (5, "", "x"),
    (6, "Élodie N'Diaye", "éàü"), (7, "ΟΔΟΣ ΟΔΟΣΑ", "İstanbul"), (8, "a\\b", "line\nbreak"), (9, "😀😃ab", "ab😀"),
    (10, "nul\x00nul", "a%b_c"), (11, "aaaaaa", "Diallo"), (12, "ana", "ends with %"), (13, "ana", "same"),
]
QUERIES = [
    "ana", "ANA", "dial", "Diallo", "", "%", "_", "__", "x_y", "X\\_Y", "a%o", "%%", "\\%", "50\\%", "\\Bob", "\\\\", "a\\\\b",
    "é", "élodie", "ÉÀÜ", "οδος", "ΟΔΟΣ", "istan", "İst", "line\nb", "e\nb", "😀", "😀😃a", "nul\x00", "aaaa", "zzz", "n%n", "ab_",
    "ana%lo", "di%al%lo", "%dia%", "b", "bo", "bob", "bob ", "with \\",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id bigint, name string, adresse string")
    index = ti.TextIndex(str(tmp_path_factory.mktemp("index") / "i"), parts=4)
    ti.write_index(rows, index)
    return rows, index


def ids(df):
    return sorted(r.id for r in df.collect())


def expected(spark, rows, queries):
    return {(i, q) for q in queries for i in ids(search.search(rows, q))}


def test_table_of_queries_equals_single_searches(spark, indexed):
    rows, index = indexed
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, "ana", None]], "text string")
    found = [(r.id, r.q) for r in ti.search_queries(rows, index, asked, "text").collect()]
    assert len(found) == len(set(found)) and set(found) == expected(spark, rows, QUERIES)


@pytest.mark.parametrize("query", ["dial", "ÉÀÜ", "a%o", "", "50\\%", "zzzz", "ana%lo", "😀😃a", "x_y"])
def test_indexed_search_equals_search(indexed, query):
    rows, index = indexed
    assert ids(ti.search_indexed(rows, index, query)) == ids(search.search(rows, query))


def test_quoting_goes_pair_by_pair(indexed):
    rows, _ = indexed
    assert ids(search.search(rows, "a\\\\b")) == [8] and ids(search.search(rows, "\\a\\n\\a")) == [1, 3, 12, 13]


def test_a_lookup_reads_the_postings_of_one_trigram(spark, indexed):
    rows, index = indexed
    text = plan(ti.search_indexed(rows, index, "Diallo"))
    assert re.search(r"PushedFilters: \[IsNotNull\(gram\), EqualTo\(gram,\w+\)", text)
    assert re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = \d+\)\]", text)
    assert ti.candidates(spark, index, "a%b") is None


def test_the_rarest_trigram_is_chosen(spark, indexed):
    _, index = indexed
    assert ids(ti.candidates(spark, index, "ananas")) == [3]  # "nas", not "ana"


def test_stored_table_reads_the_listed_buckets_only(spark, tmp_path):
    rows = spark.range(300).select("id", F.concat(F.lit("person "), "id").alias("name"), F.lit("street").alias("adresse"))
    table = ts.StoredTable(str(tmp_path / "table"), 16)
    ts.create_table(spark, table, conform(rows))
    index = ti.TextIndex(str(tmp_path / "index"), parts=4)
    ti.write_index(ts.read_table(spark, table), index)
    found = ti.search_stored(spark, table, index, "n 299")
    assert ids(found) == [299]
    assert re.search(r"PartitionFilters: \[[^\n]*\(bucket#\d+ = \d+\)", plan(found))
    assert len(ids(ti.search_stored(spark, table, index, "ee"))) == 300


def test_ten_thousand_queries_without_a_theta_join(spark, tmp_path):
    parts = stand_ins.parts(spark, "/root/testdata/sf0.01")
    index = ti.TextIndex(str(tmp_path / "index"))
    ti.write_index(parts, index)
    word, size = F.element_at(F.array(*map(F.lit, ["widget", "g_ar", "SMALL", "ing%o", "bolt", "e", "", "o%", "ar", "qq"])), (F.col("id") % 10 + 1).cast("int")), F.col("id") % 7
    queries = spark.range(10_000).select(F.concat(word, F.when(size > 2, F.concat(F.lit("%"), F.col("id").cast("string"))).otherwise("")).alias("q"))
    found = ti.search_queries(parts, index, queries)
    text = plan(found, "simple")
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text
    got = {(r.id, r.q) for r in found.select("id", "q").collect()}
    few = [r.q for r in queries.select("q").distinct().collect()]
    assert len(few) > 5000
    texts = [(r.id, (r.name or "").lower(), (r.adresse or "").lower()) for r in parts.collect()]
    want = set()
    for q in few:
        rx = re.compile(".*".join(".".join(map(re.escape, p.split("_"))) for p in q.lower().split("%")))
        want |= {(i, q) for i, a, b in texts if rx.search(a) or rx.search(b)}
    assert got == want


def test_empty_tables(spark, indexed, tmp_path):
    rows, index = indexed
    none = spark.createDataFrame([], "q string")
    assert ti.search_queries(rows, index, none).isEmpty()
    empty = ti.TextIndex(str(tmp_path / "e"), parts=2)
    ti.write_index(rows.limit(0), empty)
    assert ti.search_queries(rows.limit(0), empty, spark.createDataFrame([("abc",), ("a",)], "q string")).isEmpty()
    assert ti.search_indexed(rows.limit(0), empty, "abcd").isEmpty()


def test_most_queries_are_settled_by_plain_comparisons(spark, indexed):
    asked = spark.createDataFrame([(q,) for q in QUERIES], "q string")
    parsed = {r.q: r for r in ti.parsed_queries(asked).collect()}
    settled = {q: (r.head, r.tail) for q, r in parsed.items() if r.enough}
    assert settled["ANA"] == ("ana", "") and settled["a%o"] == ("a", "o") and settled["nul\x00"] == ("nul\x00", "")
    assert settled["X\\_Y"] == ("x_y", "") and settled["50\\%"] == ("50%", "") and settled[""] == ("", "")
    assert {"_", "__", "x_y", "ab_", "di%al%lo", "with \\"}.isdisjoint(settled)
    assert (parsed["di%al%lo"].head, parsed["di%al%lo"].tail) == ("di", "lo")


def test_pairs_with_queries_are_not_shuffled(spark, indexed):
    """The rows of the postings are met before the queries; with small queries nothing follows."""
    rows, index = indexed
    found = ti.search_queries(rows, index, spark.createDataFrame([("ana",), ("di_llo",)], "q string"))
    found.collect()
    text = plan(found, "simple").split("Initial Plan")[1]
    by_gram = text[: text.index("_run")]
    queries = by_gram.index("Join [gram")
    assert "Exchange hashpartitioning" not in by_gram[:queries] and "Join [id" in by_gram[queries:]
