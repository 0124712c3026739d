"""Every registered query with a SQL twin gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from vigilframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat(" ")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, db, name):
    got = registry.queries()[name](spark, sf)
    want = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    mine = sorted([str([plain(r[c]) for c in order]) for r in got.collect()])
    theirs = sorted([str([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in want.fetchall()])
    assert mine == theirs


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
