"""Every registered query against its SQL twin, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    ok, text = compare(spark, tables, SF, entry.queries()[name], entry.oracle_sql().get(name))
    if ok is None:
        pytest.skip(f"{name} has no SQL twin: {text}")
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
