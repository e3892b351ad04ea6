"""The operators against their SQL in DuckDB, row by row."""

import pytest
from oracle_check import connect, difference

from lendscope.llm.queries import QUERIES
from lendscope.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, small_dir, name):
    got = QUERIES[name](spark, small_dir).toArrow()
    assert difference(got, connect(small_dir).sql(ORACLE[name]).to_arrow_table()) == ""
