"""Evaluation takes only the rows of judged documents out of a ranking, and the last row of each query."""

import pytest

from quillsearch.operators import evaluate, retrieve
from quillsearch.operators.index import Index
from quillsearch.plans.engine import SearchEngine

DOCS = {d: f"w{d % 7} w{d % 5} w{d % 3} all" for d in range(60)}
QUERIES = {f"q{i}": f"w{i % 7} w{i % 2}" for i in range(40)} | {"none": "unknown"}


@pytest.fixture(scope="module")
def made(spark):
    return Index.build(spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"))


@pytest.mark.parametrize("k", [5, 1000])
def test_metrics_of_sparse_rows(spark, made, rows, monkeypatch, k):
    asked = spark.createDataFrame(list(QUERIES.items()), "qid string, text string")
    qrels = spark.createDataFrame([(f"q{i}", (i * 7 + j * j) % 60) for i in range(30) for j in range(4)], "qid string, doc_id long")
    full = retrieve.exhaustive_top_k(made, asked, k)
    want = rows(evaluate.per_query(full, qrels, asked))
    monkeypatch.setattr(retrieve, "FEW_TERMS", 0)
    some = retrieve.top_k(made, asked, k, judged=qrels)
    assert some.count() <= 40 + qrels.distinct().count() and not some.exceptAll(full).count()
    assert rows(evaluate.per_query(some, qrels, asked)) == want
    assert rows(SearchEngine(made).evaluate_per_query(asked, qrels, k)) == want
