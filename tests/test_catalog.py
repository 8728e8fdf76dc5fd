"""Every query of the catalog against its SQL twin in DuckDB, over the driver's small tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from reelproof.plans import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.01")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    cur = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a, b, strict=True)), (a, b)
    assert got or name in ()
