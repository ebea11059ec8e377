"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def same(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = tables.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    expected = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
