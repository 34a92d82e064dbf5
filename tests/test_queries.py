"""Every named query against its SQL, and the driver's entry points."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_point  # noqa: E402

from millrace import queries as own  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canon(rows):
    return sorted(repr(tuple(list(x) if isinstance(x, (list, tuple)) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(own.queries()))
def test_query(spark, sf, con, name):
    df = own.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in own.oracle_sql():
        assert got
        return
    sql = own.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == cols
    assert canon(got) == canon(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["event_type", "h", "avg_value"] and df.count() > 0
    assert set(own.queries()) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
