"""Every registered query against its SQL text on the smallest data."""

import pytest
from conftest import SMALL
from oracle import compare, connect

from quotemill.plans.registry import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    df = q(spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    if q.sql is None:
        df.collect()
    else:
        assert compare(df, con, q.sql) == []


def test_entry_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
