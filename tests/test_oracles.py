"""Every query that has SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import connect, difference

from tickfold.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(con, QUERIES[name](spark, SF), ORACLES[name]) == ""


def test_mixture_has_weights_that_sum_to_one(spark):
    rows = QUERIES["runtime_gmm"](spark, SF).collect()
    assert len(rows) == 3 and abs(sum(r.weight for r in rows) - 1) < 1e-5
    assert [r["mean"] for r in rows] == sorted(r["mean"] for r in rows)


def test_entry_has_rows_of_all_factors(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 410 and len(df.columns) == 22
    assert set(e.oracle_sql()) <= set(e.queries())
