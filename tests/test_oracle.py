"""Every registered query against its SQL twin, whole results."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from callscope.plans.catalog import QUERIES
from callscope.plans.oracle import ORACLE as SQL
from compare import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    with connect(sf_dir) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []
