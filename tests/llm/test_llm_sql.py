"""The queries that have SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import connect, difference

from tickfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(connect(SF), queries.queries()[name](spark, SF), queries.oracle_sql()[name]) == ""
