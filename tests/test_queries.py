from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from compare import database, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(contract.ORACLES) == set(contract.REGISTRY)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert difference(df, con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 2
