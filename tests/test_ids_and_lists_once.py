"""An index on disk: lists are encoded once, words are looked up once, and saving doesn't read the tree back."""

import pytest

from quillsearch.operators import dictionary, encoded, retrieve
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


@pytest.mark.parametrize("codec,terms", [("standard", "idmap"), ("vbe", "patricia"), ("elias-gamma", "patricia")])
def test_ids_and_lists_once(spark, made, rows, monkeypatch, tmp_path, codec, terms):
    asked = spark.createDataFrame(list(QUERIES.items()), "qid string, text string")
    want = rows(retrieve.exhaustive_top_k(made, asked, 3))
    kind = encoded.DICTIONARIES[terms]
    calls = []
    looked, count = kind.ids_of, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(kind, "ids_of", lambda self, words: calls.append("ids_of") or looked(self, words))
    lists = encoded.encoded
    monkeypatch.setattr(encoded, "encoded", lambda *a: counted(spark, lists(*a), count))
    if terms == "patricia":
        walked = kind.all
        monkeypatch.setattr(kind, "all", lambda self: calls.append("all") or walked(self))
    encoded.EncodedIndex.save(made, str(tmp_path), codec, terms)
    assert count.value == made.terms.count() and not calls
    monkeypatch.setattr(retrieve, "FEW_TERMS", 0)
    opened = encoded.EncodedIndex.load(spark, str(tmp_path), codec, terms)
    assert rows(retrieve.top_k(opened, asked, 3)) == want
    assert calls == ["ids_of"]
    assert rows(opened.scan()) == rows(made.postings, "term", "doc_id", "tf")


@pytest.mark.parametrize("few", [0, 100_000])
def test_descent_of_few_and_many(spark, made, rows, monkeypatch, few):
    monkeypatch.setattr(dictionary, "FEW_ASKED", few)
    tree = dictionary.RadixTree.build(made.terms)
    asked = spark.createDataFrame([("w1",), ("wor",), ("word10",), ("word100",), ("",), ("x",), ("wo",)], "term string")
    ids = dict(rows(dictionary.dense_ids(made.terms)))
    assert dict(rows(tree.ids_of(asked))) == {t: ids.get(t, -1) for t, in rows(asked)}
