"""Every registered query against its oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from epistride.workload import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).count() == 1000


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert compare(QUERIES[name](spark, FOLDER), oracle, ORACLES[name]) is None
