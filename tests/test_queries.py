"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert difference(QUERIES[key](spark, SF), con, ORACLES[key]) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
