"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from gleanery.plans.catalog import all_queries

from .oracle import connect, difference, rows_of, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    query = all_queries()[name]
    got = spark_rows(query(spark, FOLDER))
    assert got[1]
    if query.sql:
        assert difference(got, sql_rows(duck, query.sql)) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_rows_of_sorts_columns():
    assert rows_of(["b", "a"], [(1, 2)]) == (["a", "b"], [(("int", "2"), ("int", "1"))])
