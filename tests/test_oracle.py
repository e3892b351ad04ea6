"""Every query with SQL equals DuckDB on the smallest tables."""

import pytest
from oracle_check import check, connect

from lendscope.catalog import QUERIES
from lendscope.oracle import ORACLE

# Fitted models have no SQL form; test_plans checks their invariants.
WITHOUT_SQL = {
    "model_oof_probabilities",
    "model_test_probabilities",
    "model_metrics",
}


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = connect(small_dir)
    yield connection
    connection.close()


def test_every_query_has_sql_or_a_reason():
    assert QUERIES.keys() - ORACLE.keys() == WITHOUT_SQL
    assert not ORACLE.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, small_dir, name):
    assert check(spark, duck, name, small_dir) == ""
