"""Registered queries of this subpackage against their SQL twins."""

import os

import pytest

from twinfold.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        if os.path.exists(f"{tiny}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = queries.queries()[name](spark, tiny)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
