"""Every registered library query against its SQL oracle on DuckDB (smallest scale)."""
import pytest

import __spark_entry__ as E
from bidscope.plans.registry import QUERIES, SQL
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], SQL[name], SF, con)
    assert r["schema"] and r["values"], r


def test_entry(spark):
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    df = E.entry(spark)
    assert df.count() > 0
    assert "composite_score" in df.columns
