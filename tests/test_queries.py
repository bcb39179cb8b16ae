"""Every registered query runs, and equals its SQL twin where it has one."""

import os

import duckdb
import numpy as np
import pytest

from scorelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v


def rows(df):
    cols = sorted(df.columns)
    df = df.astype(object).where(df.notna(), None)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        a, b = rows(got.toPandas()), rows(con.sql(catalog.ORACLES[name]).df())
        assert a[0] == b[0] and len(a[1]) == len(b[1])
        assert a[1] == b[1] or all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6 * max(1, abs(x))) for r, s in zip(a[1], b[1], strict=True) for x, y in zip(r, s, strict=True))
    else:
        assert got.count() > 0  # test_brute.py holds these against plain loops


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
