"""Every registered query against its SQL on the smallest tables, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from sigspark.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries()) and len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    problems, rows = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert not problems and rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 15
