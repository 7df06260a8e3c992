"""Every harness query against its SQL on the smallest tables, where those are at hand."""

from __future__ import annotations

import datetime
import decimal
import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def names():
    from leafmill.plans import harness

    return sorted(harness.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from leafmill.plans import harness

    df = harness.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in harness.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(harness.ORACLE_SQL[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    want = [tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
