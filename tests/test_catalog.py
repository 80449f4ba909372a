"""Every registered query of the library against its DuckDB twin."""

import glob
import os

import duckdb
import pytest

from meridian.plans import catalog

from .conftest import SMALL


def compare(spark, name, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    at = [found.columns.index(c) for c in order]
    def key(row):
        return str([x for x in row if not isinstance(x, float)]), [x for x in row if isinstance(x, float)]

    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)
    mine = sorted((tuple(r[c] for c in order) for r in got), key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True)), (a, b)
    assert mine


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, os.environ.get("CATALOG_DIR", SMALL))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
