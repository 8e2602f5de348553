"""Every query of the library that SQL can express against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from quarterlight.queries import ORACLES, QUERIES
from tests.compare import database, spark_rows, sql_rows


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.collect() is not None
