"""A ranking for evaluation goes down to a query's lowest judged document among its best, and one row further; other queries aren't ranked."""

import random

import pytest

from quillsearch.operators import evaluate, retrieve
from quillsearch.operators.index import Index


@pytest.mark.parametrize("k", [1, 4, 25, 1000])
def test_down_to_the_lowest_judged(spark, rows, monkeypatch, k):
    rnd = random.Random(k)
    draw = lambda n: " ".join(f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(n))
    texts = [draw(rnd.randint(1, 12)) for _ in range(250)]
    docs = list(enumerate(texts + texts[:50]))
    made = Index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    # equal texts under several ids, with other judgments
    asked = [draw(rnd.randint(1, 5)) for _ in range(40)]
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(asked + asked[:10] + ["unknown"])], "qid string, text string")
    full = retrieve.exhaustive_top_k(made, queries, k)
    best = {}
    for qid, rank, doc, _ in rows(full):
        best.setdefault(qid, {})[rank] = doc
    judged = {(f"q{i}", rnd.randrange(320)) for i in range(0, 45) for _ in range(rnd.randint(1, 4))}
    judged |= {(q, own[rnd.choice(list(own))]) for q, own in best.items() if int(q[1:]) % 3 == 0}
    judged |= {(q, own[max(own)]) for q, own in best.items() if int(q[1:]) % 7 == 0} | {("nobody", 3)}
    qrels = spark.createDataFrame(sorted(judged), "qid string, doc_id long")
    want = rows(evaluate.per_query(full, qrels, queries))
    for name, value in (("FEW_TERMS", 0), ("HITS", 40), ("MOST_HITS", 40)):
        monkeypatch.setattr(retrieve, name, value)
    some = retrieve.top_k(made, queries, k, judged=qrels)
    got = rows(some)
    assert rows(evaluate.per_query(some, qrels, queries)) == want
    assert set(got) <= set(rows(full))
    # all judged rows, and no query of which all queries of the same text have none
    text = {f"q{i}": x for i, x in enumerate(asked + asked[:10])}
    hit = {(q, doc) for q, own in best.items() for doc in own.values()} & judged
    assert hit <= {(q, doc) for q, _, doc, _ in got}
    bags = {tuple(sorted(text[q].split())) for q, _ in hit}
    assert {tuple(sorted(text[q].split())) for q, *_ in got} == bags
