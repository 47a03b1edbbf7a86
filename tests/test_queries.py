"""Every registered query against its SQL twin, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.library_queries(), entry.library_sql()


@pytest.fixture(scope="module")
def con():
    return compare.database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare.spark_types(df) == compare.sql_types(con, SQL[name])
    got_columns, got = compare.spark_rows(df)
    want_columns, want = compare.sql_rows(con, SQL[name])
    assert got_columns == want_columns
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 150
