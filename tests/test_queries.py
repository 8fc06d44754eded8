"""Every query with SQL against DuckDB on the smallest test data."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(rows):
    def one(v):
        if v is None or v != v:
            return "~"
        return f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = canonical([[r[i] for i in at] for r in rel.fetchall()])
    assert canonical(df.select(*cols).collect()) == want


def test_every_query_is_registered():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 80
    assert {"p1_found", "p4_found", "p5_found"} <= set(q)
