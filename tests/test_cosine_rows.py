"""Full-rank cosine: no row for a pair of query and document, same rows as SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillsearch.operators import retrieve, vector

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few,terms", [(1000, 400_000), (0, 0)])
def test_no_sum_over_pairs(spark, monkeypatch, few, terms):
    monkeypatch.setattr(retrieve, "FEW_TERMS", few)
    monkeypatch.setattr(vector, "BROADCAST_TERMS", terms)
    got = entry.queries()["tfidf_cosine_topk"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate(keys=[qid" in line and "doc_id" in line for line in plan.splitlines())
    db = duckdb.connect()
    for name in ("collection_docs", "queries"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    sql = db.execute(entry.oracle_sql()["tfidf_cosine_topk"]).fetchall()
    assert sorted(tuple(r) for r in got.select("qid", "rank", "doc_id", "score").collect()) == sorted(sql)
