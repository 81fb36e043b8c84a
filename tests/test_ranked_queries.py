"""Registered rankings never meet query terms row by row with postings, and give the rows of their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "bm25_params",
    "bm25_topk_standard",
    "query_unknown_terms",
    "tfidf_topk",
    "bm25_topk",
    "bm25_topk_vbe",
    "eval_mean",
    "query_dup_terms",
    "eval_per_query",
    "bm25_topk_elias_gamma",
    "engine_evaluate",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_row_for_a_pair(spark, name):
    got = entry.queries()[name](spark, SF)
    assert "qtf" not in got._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    for table in ("collection_docs", "queries", "qrels"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
