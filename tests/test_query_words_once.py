"""The plan of a batch's words runs once, though their number decides on the plan."""

import pytest

from quillsearch.operators import retrieve
from quillsearch.operators.index import Index

DOCS = {d: f"w{d % 7} w{d % 5} word{d % 11} wo all" for d in range(80)}
QUERIES = {f"q{i}": f"w{i % 7} w{i % 2} word{i % 11} unknown" for i in range(40)}


def counted(spark, df, count):
    """``df`` through a step that counts its rows."""

    def run(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


@pytest.fixture(scope="module")
def made(spark):
    return Index.build(spark.createDataFrame(list(DOCS.items()), "doc_id long, text string"))


def test_query_words_are_found_once(spark, made, rows, monkeypatch):
    asked = spark.createDataFrame(list(QUERIES.items()), "qid string, text string")
    want = rows(retrieve.exhaustive_top_k(made, asked, 3))
    monkeypatch.setattr(retrieve, "FEW_TERMS", 0)
    count = spark.sparkContext.accumulator(0)
    terms = retrieve.weighted_terms(made, asked, "bm25").select("qid", "term", "qtf", "idf", "df")
    n = terms.count()
    monkeypatch.setattr(retrieve, "weighted_terms", lambda *_: counted(spark, terms, count).repartition(2))
    assert rows(retrieve.top_k(made, asked, 3)) == want
    assert count.value == n
