"""Every registered map query against its oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from geoloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = [tuple(map(plain, r)) for r in want.select(columns).fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert rows or name.endswith("faults") or name == "agg27_uncovered"
