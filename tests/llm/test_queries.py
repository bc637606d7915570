"""The corpus queries that SQL can express, side by side with it."""

from __future__ import annotations

import duckdb
import pytest
from cases import SF

from check_oracle import TABLES, rows
from visitbook.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_one_query_for_every_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())
