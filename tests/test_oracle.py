"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert not df.isEmpty()
    else:
        assert difference(df, duck, sql) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
