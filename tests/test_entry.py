"""Every registered query runs at the smallest scale and equals its SQL."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SLOW = {"near_duplicates"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "order_status", "logs"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, connect(sf), sql) is None
