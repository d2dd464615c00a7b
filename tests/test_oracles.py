"""Every registered query of the core against its SQL twin on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from twinfold.plans import base

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else x
    found = [tuple(plain(r[i]) if not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(found, key=lambda r: tuple((x is None, str(type(x)), f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_sql(spark, tiny, con, name):
    df = entry.queries()[name](spark, tiny)
    got = rows_of(df.columns, df.collect())
    sql = con.sql(base.ORACLES[name])
    want = rows_of(sql.columns, sql.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y))) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_runs(spark, tiny):
    assert {r["contrast"] for r in entry.entry(spark).collect()} == {"a_minus_r", "n_minus_r"}


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLES)))
def test_queries_without_sql_run(spark, tiny, name):
    assert entry.queries()[name](spark, tiny).count() > 0
