from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillsearch import cli
from quillsearch.operators.index import Index, codec_sizes, postings_of
from quillsearch.plans.engine import SearchEngine
from quillsearch.sources import collection
from quillsearch.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    for block, name, text in (("1", "7.txt", "red fish blue"), ("1", "10.txt", "red  red\n"), ("2", "x.md", "blue"), ("2", "3.txt", "green fish")):
        (tmp_path / "c" / block).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / block / name).write_text(text)
    (tmp_path / "q.txt").write_text("Q1 red fish\n\nQ2 blue\n")
    (tmp_path / "r.txt").write_text("Q1 7\nQ2 7\n\nQ1 10\n")
    return tmp_path


def test_collection(spark, folder, rows):
    (folder / "c" / "2" / "a b+ü.txt").write_text("odd name")
    got = collection.read_collection(spark, f"file://{folder}/c")
    root = f"file://{folder}/c"
    assert rows(got, "doc_id", "block", "doc_path", "doc_no") == [
        (0, "1", f"{root}/1/10.txt", 10), (1, "1", f"{root}/1/7.txt", 7), (2, "2", f"{root}/2/3.txt", 3),
        (3, "2", f"{root}/2/a b+ü.txt", None), (4, "2", f"{root}/2/x.md", None),
    ]


def test_known_judgments(spark):
    ok = spark.createDataFrame([("Q1", 166), ("Q2", 300), ("Q1", 5)], "qid string, doc_id long")
    collection.check_judgments(ok)
    for bad in (ok.where("doc_id <> 166"), ok.union(spark.createDataFrame([("Q1", 300)], "qid string, doc_id long"))):
        with pytest.raises(ValueError):
            collection.check_judgments(bad)


def test_queries_and_qrels(spark, folder, rows):
    assert rows(collection.read_queries(spark, f"file://{folder}/q.txt")) == [("Q1", "red fish"), ("Q2", "blue")]
    qrels = collection.read_qrels(spark, f"file://{folder}/r.txt")
    assert rows(qrels) == [("Q1", 10), ("Q1", 7), ("Q2", 7)]
    dense = collection.dense_qrels(qrels, 2, 10)
    assert dense.count() == 20 and dense.where("rel = 1").count() == 3
    assert collection.demo_queries(spark).count() == 3


def test_streamed_index(spark, folder, rows):
    out, mark = f"file://{folder}/p", f"file://{folder}/m"
    stream = lambda: incremental.append_postings(incremental.read_blocks(spark, f"file://{folder}/c"), out, mark)
    stream().awaitTermination()
    time.sleep(1)
    (folder / "c" / "2" / "8.txt").write_text("red green")
    stream().awaitTermination()
    docs = collection.read_collection(spark, f"file://{folder}/c")
    numbers = docs.where("doc_no is not null").select(F.col("doc_no").alias("doc_id"), "text")
    assert rows(incremental.merged(spark, out).where("doc_id >= 0")) == rows(postings_of(numbers))
    # batch by batch or at once: the same statistics
    so_far, whole = incremental.index_so_far(spark, out), Index.build(docs)
    assert rows(so_far.terms) == rows(whole.terms)
    assert (so_far.n_docs, so_far.avg_dl, so_far.min_dl) == (whole.n_docs, whole.avg_dl, whole.min_dl)
    assert rows(so_far.paths, "doc_path", "doc_no")[:2] == rows(whole.paths, "doc_path", "doc_no")[:2]


@pytest.mark.parametrize("codec,terms", [("vbe", "patricia"), ("elias-gamma", "idmap"), ("standard", "idmap")])
def test_command_line(folder, capsys, codec, terms):
    at = f"file://{folder}/index"
    how = ["--output-dir", at, "--compression", codec, "--term-dict", terms]
    cli.main(["index", "--data-dir", f"file://{folder}/c", *how])
    cli.main(["vector-build", "--data-dir", f"file://{folder}/c", "--output-dir", f"{at}-v", "--components", "2"])
    for kind in ("full", "wand", "faiss"):
        cli.main(["search", "blue", *how, "--retrieval", kind, "--vector-dir", f"{at}-v", "--bm25-k1", "1.5"])
    judged = ["--query-file", f"file://{folder}/q.txt", "--qrels", f"file://{folder}/r.txt"]
    with pytest.raises(ValueError):
        cli.main(["evaluate", *how, *judged])
    cli.main(["evaluate", *how, *judged, "--any-judgments", "--scoring", "bm25"])
    out = capsys.readouterr().out
    assert "4 documents" in out and "n_queries: 2" in out and "ap: 0." in out
    # a file of any name is found and named by its path
    assert out.count(f"file://{folder}/c/2/x.md") == 3 and out.count("Query  : blue") == 3
    with pytest.raises(FileNotFoundError):
        cli.main(["search", "blue", *how, "--retrieval", "faiss"])


COLLECTION = os.environ.get("QUILL_COLLECTION", str(Path(__file__).resolve().parents[2] / "reference" / "collection"))


@pytest.mark.skipif(not os.path.isdir(COLLECTION), reason="no collection")
def test_known_figures_of_a_collection(spark, rows):
    """Statistics, sizes of encoded lists and best documents that are known for 606 abstracts."""
    docs = collection.read_collection(spark, f"file://{COLLECTION}")
    index = Index.build(docs, "bsbi")
    assert (index.n_docs, index.min_dl, index.docs.agg(F.sum("dl"), F.max("dl")).head()[:]) == (606, 20, (60899, 171))
    assert index.avg_dl == pytest.approx(100.49339933993399)
    terms = index.terms.agg(F.count("*"), F.sum("df"), F.max("max_tf"), F.max("df"), F.sum((F.col("df") == 1).cast("int"))).head()
    assert terms[:] == (11010, 40174, 23, 600, 7100)
    sizes = codec_sizes(index.postings).agg(F.sum("std_bytes"), F.sum("vbe_bytes"), F.sum("eg_bytes")).head()
    assert sizes[:] == (642_784, 91_005, 158_507)
    # fixed values: the five best documents of the demonstration queries
    best = {
        "tfidf": {"D1": [(507, 27.082513), (247, 8.251918), (745, 8.251918), (793, 7.32699), (119, 4.768172)],
                  "D2": [(820, 20.805124), (821, 14.236747), (36, 10.37167), (853, 7.652545), (802, 6.75626)],
                  "D3": [(7, 34.809679), (371, 11.596837), (328, 9.495924), (103, 7.796302), (139, 7.746516)]},
        "bm25": {"D1": [(507, 19.087737), (793, 6.747069), (247, 6.198691), (745, 5.938726), (119, 4.940728)],
                 "D2": [(820, 16.89855), (821, 10.041717), (36, 8.33806), (853, 6.334383), (350, 5.30586)],
                 "D3": [(7, 25.529166), (371, 9.377296), (602, 8.020591), (328, 7.930285), (103, 7.151382)]},
    }
    engine = SearchEngine(index)
    for mode, want in best.items():
        for kind in ("full", "wand"):
            got = collection.with_paths(engine.search(collection.demo_queries(spark), 5, mode, kind), engine.paths)
            found = {q: [(r["doc_no"], r["score"]) for r in got.where(F.col("qid") == q).orderBy("rank").collect()] for q in want}
            for q in want:
                assert [d for d, _ in found[q]] == [d for d, _ in want[q]]
                assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-5)
