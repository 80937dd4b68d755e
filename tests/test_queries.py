"""Every query against its SQL in DuckDB, or at least its schema and rows."""

import glob
import math
import os

import duckdb
import pytest

from tickloom import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return "inf" if math.isinf(x) else float(round(x, 4))
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    found = (tuple(map(cell, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))
    number = lambda x: isinstance(x, float)
    return sorted(found, key=lambda r: (tuple("" if number(x) else x for x in r), tuple(x if number(x) else 0.0 for x in r)))


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-4, abs_tol=2e-4)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.SQL:
        assert len(got.columns) and (len(got) or name in ("in_trade_bars", "trade_funding"))
        return
    want = db.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s)), next((r, s) for r, s in zip(a, b) if r != s)
