"""Ranking in packed chunks against the sums over all pairs."""

import random

import pytest

from quillsearch.operators import encoded, evaluate, retrieve
from quillsearch.operators.index import Index

_RANDOM = random.Random(3)
DOCS = {d: " ".join(f"w{min(int(_RANDOM.expovariate(0.12)), 40)}" for _ in range(_RANDOM.randint(1, 30))) for d in range(120)}
QUERIES = {f"q{i}": " ".join(f"w{_RANDOM.randint(0, 40)}" for _ in range(_RANDOM.randint(1, 6))) for i in range(30)} | {"all": "w0 all w1"}


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame([(d, f"{t} all") for d, t in DOCS.items()], "doc_id long, text string")
    return Index.build(docs)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "qid string, text string")


def pair_sums(df):
    """Aggregates over pairs of query and document in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Aggregate(keys=[qid" in line and "doc_id" in line for line in plan.splitlines())


@pytest.mark.parametrize("mode,k1,b", [("tfidf", 1.2, 0.75), ("bm25", 1.2, 0.75), ("bm25", 2.0, 0.5)])
@pytest.mark.parametrize("k,chunk,cut,dense,lead", [(3, 10**6, 1 << 20, 8, 20), (3, 100, 1, 1, 1), (1, 40, 1 << 20, 100, 1), (1000, 300, 2000, 4, 1)])
def test_rows_of_all_pairs(made, queries, rows, monkeypatch, mode, k1, b, k, chunk, cut, dense, lead):
    want = rows(retrieve.exhaustive_top_k(made, queries, k, mode, k1, b))
    assert rows(retrieve.top_k(made, queries, k, mode, k1, b)) == want
    for name, value in (("FEW_TERMS", 0), ("CHUNK", chunk), ("HITS", chunk), ("CHUNK_BYTES", cut), ("DENSE", dense), ("LEAD_DOCS", lead), ("TASK_RESULTS", 40)):
        monkeypatch.setattr(retrieve, name, value)
    packed = retrieve.top_k(made, queries, k, mode, k1, b)
    assert rows(packed) == want and pair_sums(packed) == 0


def test_no_sum_over_pairs_bm25_params(made, queries):
    assert pair_sums(retrieve.top_k(made, queries, 10, k1=2.0, b=0.5)) == 0
