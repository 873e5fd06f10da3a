"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries() if os.path.isdir(SF_DIR) else {}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF_DIR)
    got = rows_of(found.columns, found.collect())
    if name in ORACLES:
        records = db.execute(ORACLES[name]).fetchall()
        assert got == rows_of([d[0] for d in db.description], records)
    else:
        assert got[1]


def test_entry(spark):
    assert contract.entry(spark).columns[:3] == ["query_id", "rank", "chunk_id"]
