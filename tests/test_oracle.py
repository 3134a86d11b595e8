"""Every registered query of the search engine against DuckDB on the smallest fixture."""

import duckdb
import pytest

from vecprune.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(columns).collect()))
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
    want = sorted(cursor.fetchall())
    assert rows == want
    assert rows
