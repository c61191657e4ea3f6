"""Operators against the SQL of their contracts over the small driver tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from vecsieve.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.split('.')[0]} as from '{SF}/{table}'")
    want = con.sql(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0 and all((got[c] == want[c]).all() for c in columns)
