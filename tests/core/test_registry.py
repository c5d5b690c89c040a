"""Every core query runs and agrees with its oracle in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sluice.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    rows = db.sql(ORACLES[name])
    at = [rows.columns.index(c) for c in cols]
    assert sorted(rows.columns) == cols
    want = sorted((tuple(norm(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rows.fetchall()), key=repr)
    assert got == want
