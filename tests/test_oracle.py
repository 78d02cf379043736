"""Every query of the reference's operators against DuckDB on the smallest tables."""

import pytest
from compare import compare, connect

from sparkshelf.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, sf, con, key):
    assert compare(QUERIES[key](spark, sf), con, ORACLE[key]) is None


@pytest.mark.parametrize("key", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs_with_named_columns(spark, sf, key):
    df = QUERIES[key](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [f for f in rows[0].asDict()] == ["id", "family", "score"]
