"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect

from crewframe import plans as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    good, note, _ = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
