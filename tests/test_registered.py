"""Every registered query agrees with its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry
from descry.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    actual, expected = compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert actual == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
