"""Every registered query that has SQL agrees with it on the small tables."""

import pytest

import __spark_entry__ as entry_module
from conftest import DATA
from oracle import connect, differences

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, DATA), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
