"""Every query with SQL returns DuckDB's rows and types; the others return rows."""

from __future__ import annotations

import os

import pytest

from lorekeep.plans import QUERIES, SQL

from .compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_every_query_has_rows_in_sql(con):
    empty = [n for n in SQL if con.execute(f"SELECT count(*) FROM ({SQL[n]})").fetchone()[0] == 0]
    assert empty == []


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    if FOLDER == "/root/testdata/sf0.001":
        assert e.entry(spark).count() > 0
