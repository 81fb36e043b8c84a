"""Query sets of more rows than are broadcast: the postings of their words are read and packed once, equal queries are ranked once."""

from quillsearch.operators import retrieve
from quillsearch.operators.index import Index

DOCS = {d: f"w{d % 7} w{d % 5} w{d % 3} all" for d in range(60)}
QUERIES = {f"q{i}": f"w{i % 7} w{i % 2}" for i in range(40)}


def test_postings_are_read_once(spark, rows, monkeypatch):
    made = Index.build(spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"))
    asked = spark.createDataFrame(list(QUERIES.items()), "qid string, text string")
    want = rows(retrieve.exhaustive_top_k(made, asked, 3))
    reads = []
    hits = Index.hits
    monkeypatch.setattr(Index, "hits", lambda self, words: reads.append(1) or hits(self, words))
    for name, value in (("FEW_TERMS", 0), ("BLOCK_TERMS", 20)):
        monkeypatch.setattr(retrieve, name, value)
    assert rows(retrieve.top_k(made, asked, 3)) == want and len(want) == 120
    assert len(reads) == 1


def test_more_words_than_are_broadcast(spark, rows, monkeypatch):
    made = Index.build(spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"))
    asked = spark.createDataFrame(list(QUERIES.items()), "qid string, text string")
    want = rows(retrieve.exhaustive_top_k(made, asked, 3))
    for name, value in (("FEW_TERMS", 0), ("BLOCK_TERMS", 5)):
        monkeypatch.setattr(retrieve, name, value)
    assert rows(retrieve.top_k(made, asked, 3)) == want
