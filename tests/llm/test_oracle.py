"""The queries that SQL can express, against DuckDB."""
import pytest

from bidscope.llm.queries import QUERIES, SQL
from tools.check_oracle import compare, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, name, QUERIES[name], SQL[name], sf, duck(sf))
    assert r["schema"] and r["values"], r
