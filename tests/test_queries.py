"""Every query against its DuckDB statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from playseq.plans.catalog import QUERIES
from tests.conftest import SF
from tools.compare import TABLES, rows


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(entry.oracle_sql()) & set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
