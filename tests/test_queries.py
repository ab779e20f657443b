"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from arborlake.queries import ORACLES, QUERIES

DIR = os.environ.get("QUERY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) if v != int(v) else int(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
