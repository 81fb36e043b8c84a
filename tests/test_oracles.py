"""Every query that isn't in a subpackage of its own against its SQL oracle on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillsearch.plans import core_queries, search_queries

DATA = "/root/testdata/sf0.001"
ALL = {**core_queries.QUERIES, **search_queries.QUERIES}
SQL = {**core_queries.ORACLES, **search_queries.ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(row):
    return tuple(f"{x:.6f}" if isinstance(x, float) else "" if x is None else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = ALL[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(plain, map(tuple, got.select(columns).collect()))) == sorted(map(plain, want))


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, DATA).count() > 0
