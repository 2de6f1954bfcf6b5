"""Every registered query against its SQL twin on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = pd.DataFrame(cursor.fetchall(), columns=columns, dtype=object)
    assert canonical(pd.DataFrame(rows, columns=got.columns, dtype=object)) == canonical(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 12
