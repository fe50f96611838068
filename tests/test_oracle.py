"""Every registered query runs; those with a SQL twin agree with it."""
import pytest
from check import compare, duck

from bermline.plans.registry import all_queries, all_sql

D = "/root/testdata/sf0.001"
SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, D)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert len(df.columns) > 0 and not df.isEmpty()
