"""Every query with an SQL counterpart gives the same rows on the test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from comparing import connect, differences

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 20
