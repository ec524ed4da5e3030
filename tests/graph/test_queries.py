"""Every registered query of the graph engine against its oracle SQL in DuckDB, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def said(v):
    return "N" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(said(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert columns
        return
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(said(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
