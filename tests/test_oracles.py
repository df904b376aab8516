"""Every query of the report against its SQL counterpart on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from orgpulse.plans.oracles import ORACLES
from orgpulse.plans.queries import QUERIES
from tests.oracle_check import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.sql(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 150
