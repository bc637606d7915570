from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SF, plan

import __spark_entry__ as contract
from check_oracle import TABLES, rows
from visitbook.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() <= contract.queries().keys()
    assert QUERIES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("missing", ["visitbook.llm.queries", "corpus_pipeline"])
def test_corpus_queries_are_optional(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)
    assert contract.queries().keys() == QUERIES.keys()


def test_corpus_queries_go_with_what_they_need():
    """In a process of its own, since modules that are loaded stay so."""
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2


def test_entry(spark):
    assert contract.entry(spark).columns == ["day", "n", "revenue"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    text = plan(df, "simple")
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())
