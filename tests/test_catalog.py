"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import catalog, catalog_arrays, catalog_formulas, catalog_functions, catalog_more  # noqa: F401  (registers its queries)

FOLDER = os.environ.get("TESSERA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = tables.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0
