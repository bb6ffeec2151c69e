"""Every registered query against its SQL, on the given test tables."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import TESTDATA

import __spark_entry__ as contract
from stallwise.plans.catalog import REPORTS

FOLDER = str(TESTDATA / "sf0.01")
QUERIES = {name: query for name, query in contract.queries().items() if name in REPORTS}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in REPORTS}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["day_of_week_profile", "hour_of_day_profile", "rfm_base", "delivery_overall"])
def test_session_time_zone_does_not_matter(spark, duck, setting, name):
    setting("spark.sql.session.timeZone", "America/Sao_Paulo")
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None
