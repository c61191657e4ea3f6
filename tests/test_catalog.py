"""Catalogue queries against DuckDB over the small driver tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from vecsieve.plans import catalog, catalog_more  # noqa: E402, F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = tables.sql(catalog.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
