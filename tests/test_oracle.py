"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import pytest
import os
import sys
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return connect(SF_DIR)


def names():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


def test_every_sql_belongs_to_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    ok, note = compare(spark, SF_DIR, name, duck)
    assert ok, note
