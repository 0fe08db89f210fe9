"""Every registered query with a SQL twin gives its rows, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    error, n, _, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert error is None, error
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
