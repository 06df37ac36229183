"""Every registered query against its SQL on the smallest shared tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_reads_the_tables():
    for name, sql in ORACLES.items():
        assert any(table in sql for table in TABLES), name
