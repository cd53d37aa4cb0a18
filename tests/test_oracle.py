"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

SQL = contract.oracle_sql()
SLOW = {"forecast_7d", "forecast_eval", "forecast_accuracy", "insight_report", "topics"}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    assert difference(contract.queries()[name](spark, sf), db, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(SQL) - SLOW))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 30
