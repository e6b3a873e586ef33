"""Every registered query against its oracle text on whole tables."""

import warnings

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = QUERIES[name](spark, sf).toPandas()
    assert got.columns.is_unique
    if name in ORACLES:
        assert differences(got, con.execute(ORACLES[name]).fetchdf()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
