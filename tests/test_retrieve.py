from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillsearch.operators import evaluate, retrieve, vector
from quillsearch.operators.index import Index
from quillsearch.plans.engine import SearchEngine

random.seed(4)
WORDS = [f"w{i}" for i in range(30)]
DOCS = {d: " ".join(random.choices(WORDS, weights=[1 / (i + 1) for i in range(30)], k=random.randint(1, 25))) for d in range(60)}
QUERIES = {f"q{i}": " ".join(random.choices(WORDS + ["unknown"], k=random.randint(1, 5))) for i in range(12)}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def made(corpus):
    return Index.build(corpus)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "qid string, text string")


def brute(text, mode, k, k1=1.2, b=0.75):
    tf = {d: Counter(t.split()) for d, t in DOCS.items()}
    n, avg = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    total: dict[int, float] = {}
    for w in text.split():
        df = sum(w in c for c in tf.values())
        for d, c in tf.items():
            if f := c[w]:
                if mode == "tfidf":
                    s = math.log(n / df) * (1 + math.log(f))
                else:
                    s = math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * sum(c.values()) / avg))
                total[d] = total.get(d, 0) + s
    best = sorted(((-round(s, 6), d) for d, s in total.items()))[:k]
    return [(d, -s) for s, d in best]


@pytest.mark.parametrize("mode", ["tfidf", "bm25"])
@pytest.mark.parametrize("run", [retrieve.top_k, retrieve.pruned_top_k])
@pytest.mark.parametrize("k", [1, 7])
def test_against_brute_force(made, queries, mode, run, k):
    got: dict[str, list] = {q: [] for q in QUERIES}
    for r in run(made, queries, k, mode).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["doc_id"], r["score"]))
    for q, text in QUERIES.items():
        want = brute(text, mode, k)
        assert [d for d, _ in got[q]] == [d for d, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("run", [retrieve.top_k, retrieve.pruned_top_k])
def test_query_sets_in_blocks(made, queries, rows, run, monkeypatch):
    whole = rows(run(made, queries, 4))
    monkeypatch.setattr(retrieve, "BLOCK_TERMS", 6)
    monkeypatch.setattr(retrieve, "CHUNK", 5)
    monkeypatch.setattr(retrieve, "LEAD_DOCS", 1)
    assert rows(run(made, queries, 4)) == whole


def test_pruning_kernel_passes_over_documents():
    """Random chunks: the kernel's best are those of a full sum, with few and with many chunks."""
    rng = np.random.default_rng(3)
    n_docs, n_words = 400, 12
    s = np.where(rng.random((n_docs, n_words)) < 0.3, np.round(rng.random((n_docs, n_words)) * np.arange(1, 13), 1), 0)
    doc, no = np.nonzero(s)
    batch = pa.RecordBatch.from_arrays([pa.array(doc), pa.array(no), pa.array(s[doc, no])], names=["doc_id", "no", "s"])
    starts, word = np.array([0, 3, 8, 12]), np.array([0, 5, 11, 1, 2, 3, 9, 10, 4, 6, 7, 8])
    weight = rng.integers(1, 3, len(word)).astype(float)
    run = retrieve.best_of(starts, word, weight, n_words, 5)
    for chunk, lead in ((10**6, 20), (50, 1), (1, 1)):
        retrieve.CHUNK, retrieve.LEAD_DOCS, old = chunk, lead, (retrieve.CHUNK, retrieve.LEAD_DOCS)
        got = pa.Table.from_batches(run(batch.slice(i, 7) for i in range(0, batch.num_rows, 7))).to_pylist()
        retrieve.CHUNK, retrieve.LEAD_DOCS = old
        for q in range(3):
            own = slice(starts[q], starts[q + 1])
            total, has = (s[:, word[own]] * weight[own]).sum(1), (s[:, word[own]] > 0).any(1)
            want = sorted((-round(float(x), 6), d) for d, x in enumerate(total) if has[d])[:5]
            assert sorted((-r["score"], r["doc_id"]) for r in got if r["q"] == q) == want


def test_bad_arguments(made, queries):
    with pytest.raises(ValueError):
        retrieve.top_k(made, queries, 0)
    with pytest.raises(ValueError):
        retrieve.top_k(made, queries, 3, "dfr")
    with pytest.raises(ValueError):
        SearchEngine(made).search(queries, retrieval="maybe")
    with pytest.raises(ValueError):
        SearchEngine(made).search(queries, retrieval="faiss")


def test_unknown_and_null_queries(spark, made):
    q = spark.createDataFrame([("a", "nothing known"), ("b", None), ("c", "")], "qid string, text string")
    assert retrieve.top_k(made, q).count() == 0 and retrieve.pruned_top_k(made, q).count() == 0


def test_bounds_hold(made):
    best = retrieve.term_bounds(made).where("ub_bm25 <= 0").count()
    assert best == 0


def metric(spark, rel, **options):
    df = spark.createDataFrame([("q", i + 1, r) for i, r in enumerate(rel)], "qid string, rank long, rel int")
    return tuple(evaluate.metrics(df, **options).head())[1:]


def test_metrics(spark):
    assert metric(spark, [1, 0, 1, 1, 0]) == pytest.approx((0.4304, 1.9306765580733931, 0.9060254355346823, 0.8055555555555555))
    assert metric(spark, [1]) == pytest.approx((0, 1, 1, 1))
    assert metric(spark, [0, 0]) == (0, 0, 0, 0)
    assert metric(spark, [1], strict=True)[0] == pytest.approx(0.2)


def test_queries_without_results_count(spark, made, queries):
    qrels = spark.createDataFrame([("q1", 3)], "qid string, doc_id long")
    per = SearchEngine(made).evaluate_per_query(queries, qrels, 10)
    assert per.count() == len(QUERIES)
    assert SearchEngine(made).evaluate(queries, qrels, 10).head()["n_queries"] == len(QUERIES)
    with pytest.raises(ZeroDivisionError):
        SearchEngine(made).evaluate(queries.limit(0), qrels, 10)


def test_lsi_at_full_rank_is_cosine(spark, corpus, queries, rows, tmp_path):
    # a word and its twin always come together, so one component fewer than words is full rank
    twins = spark.createDataFrame([(d, t.replace("w0", "w0 twin")) for d, t in DOCS.items()], "doc_id long, text string")
    lsi = vector.LsiIndex.build(twins, 1000)
    got = {(r["qid"], r["doc_id"]): r["score"] for r in lsi.query(queries, 60).collect()}
    for r in vector.cosine_top_k(twins, queries, 5).collect():
        assert got[r["qid"], r["doc_id"]] == pytest.approx(2 * r["score"] - 2, abs=1e-3)
    lsi.save(f"file://{tmp_path}/v")
    assert vector.LsiIndex.has_artifacts(spark, f"file://{tmp_path}/v")
    assert rows(vector.LsiIndex.load(spark, f"file://{tmp_path}/v").docs) == rows(lsi.docs)
    with pytest.raises(ValueError):
        vector.LsiIndex.build(corpus.limit(0), 4)
    # a query of unknown words has no vector and no result
    assert lsi.query(spark.createDataFrame([("z", "§")], "qid string, text string")).count() == 0


def test_knn(spark, rows):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (None, [1.0, 1.0])], "id long, vec array<float>")
    got = rows(vector.knn(v, v.where("id = 1"), 5))
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, -1.0), (1, 3, 3, -1.0)]
    with pytest.raises(ValueError):
        vector.knn(v, v, 0)


def test_knn_in_blocks_of_queries(spark, rows, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(90)], "id long, vec array<float>")
    whole = rows(vector.knn(v, v, 4))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 25)
    assert rows(vector.knn(v, v, 4)) == whole and len(whole) == 360
    assert vector.knn(v, v.limit(0), 4).count() == 0


def test_knn_of_many_equal_vectors(spark, rows):
    """More copies in a batch than any fixed number of candidates: the least ids come first."""
    data = [(5000 - i, [1.0, 2.0]) for i in range(3000)] + [(i, [float(i), 0.0]) for i in range(1, 200)] + [(9000, [1.0, 2.0])]
    v = spark.createDataFrame(data, "id long, vec array<float>").coalesce(1)
    got = rows(vector.knn(v, v.where("id = 9000"), 9))
    assert got == [(9000, r + 1, 2001 + r, 0.0) for r in range(9)]


def decomposed(texts, queries, width):
    """Scores of all pairs by a full decomposition."""
    words = sorted({w for t in texts.values() for w in t.split()})
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in t.split() for t in texts.values()))) + 1 for w in words}

    def matrix(rows):
        x = np.array([[t.split().count(w) * idf[w] for w in words] for t in rows], float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    a = matrix(texts.values())
    v = np.linalg.svd(a, full_matrices=False)[2][:width].T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return 2 * unit(matrix(queries) @ v) @ unit(a @ v).T - 2


@pytest.mark.parametrize("broadcast,driver", [(64 << 20, 0), (3000, 0), (64 << 20, 1 << 30), (3000, 1 << 30)])
def test_lsi_is_the_decomposition_of_all_documents(spark, monkeypatch, broadcast, driver):
    """More terms than one block of the iteration has columns; every document has a word of its own."""
    monkeypatch.setattr(vector, "MORE_COLUMNS", 4)
    monkeypatch.setattr(vector, "TERM_BLOCK", 16)
    monkeypatch.setattr(vector, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(vector, "DRIVER_BYTES", driver)
    texts = {d: f"{t} own{d}" for d, t in DOCS.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = [f"own{d}" for d in DOCS] + list(DOCS.values())[:20]
    lsi = vector.LsiIndex.build(docs, 16)
    assert lsi.terms.count() == len({w for t in DOCS.values() for w in t.split()}) + len(DOCS) and lsi.components == 16
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "qid string, text string")
    want = decomposed(texts, asked, 16)
    got = np.zeros_like(want)
    for r in lsi.query(df, len(DOCS)).collect():
        got[int(r["qid"][1:]), r["doc_id"]] = r["score"]
    assert np.abs(got - want).max() < 1e-3
