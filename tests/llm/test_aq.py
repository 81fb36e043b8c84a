from __future__ import annotations

import numpy as np
import pytest

from quillsearch.llm import aq

DIM = 16


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(DIM)
        rows += [(100 * c + i, (centre + 0.15 * rng.standard_normal(DIM)) * rng.uniform(0.1, 9)) for i in range(9)]
    rows += [(3000 + i, rng.standard_normal(DIM)) for i in range(60)]
    same = rows[0][1]
    rows += [(5000 + i, same) for i in range(12)] + [(5100, rows[9][1]), (5100, rows[9][1])]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    bad = [(6000, None), (6001, [0.0] * DIM), (6002, [1.0] * (DIM - 1)), (6003, [float("nan")] + [1.0] * (DIM - 1)), (None, rows[0][1])]
    return rows, bad


def brute(rows, k, least):
    data = dict(rows)
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(x @ x.T, 6)
    np.fill_diagonal(cos, -2)
    out = set()
    for r, i in enumerate(ids):
        for c in np.lexsort((ids, -cos[r]))[:k]:
            if cos[r, c] >= least:
                out.add((int(i), int(ids[c])))
    return out


@pytest.mark.parametrize("least", [0.85])
def test_similar_vectors(spark, least):
    rows, bad = vectors()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + bad], f"docno long, vec array<float>, id int, class string").repartition(5)
    got = [(r["a"], r["b"]) for r in aq.similar_vectors(df, "docno", "vec", DIM, 5, least).collect()]
    assert set(got) == brute(rows, 5, least) and len(got) == len(set(got))


def test_search(spark):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, "docno long, vec array<float>")
    got = {(r["a"], r["b"]) for r in aq.search(df, df.where("docno % 100 = 0"), "docno", "vec", DIM, 5).collect()}
    want = {p for p in brute(rows, 5, -1) if p[0] % 100 == 0}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_none(spark):
    df = spark.createDataFrame([(1, None)], "docno long, vec array<float>")
    assert aq.similar_vectors(df, "docno", "vec", DIM, 5, 0.8).count() == 0
    assert aq.search(df, df, "docno", "vec", DIM, 5).count() == 0
    one = spark.createDataFrame([(1, [1.0] * DIM)], "docno long, vec array<float>")
    assert aq.similar_vectors(one, "docno", "vec", DIM, 5, 0.8).count() == 0


def test_estimate_is_exact_for_the_vector_itself():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = aq.fit(x, 300)
    code, norm, cells = aq.encode(q, q.cross(), x)
    est = aq._looked_up(q, x, code, norm)
    assert np.allclose(np.diag(est), 1, atol=1e-4)
    assert np.abs(est - x @ x.T).mean() < 0.2 and cells.shape == (300, aq.SPILL)


def test_two_level_cells(monkeypatch):
    monkeypatch.setattr(aq, "MAX_FIRST", 4)
    monkeypatch.setattr(aq, "CELL_SIZE", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = aq.fit(x, 400)
    assert q.prefix == 2
    _, _, cells = aq.encode(q, q.cross(), x)
    assert len(np.unique(cells[:, 0])) > 4 and (cells[:, 0] != cells[:, 1]).all()


def test_search_among_many_copies(spark):
    """More copies in a batch than are reranked: those with the least ids come first, once each."""
    rng = np.random.default_rng(5)
    same = np.float32(rng.standard_normal(DIM)).tolist()
    rows = [(9000 - i, same) for i in range(2500)] + [(i, np.float32(rng.standard_normal(DIM)).tolist()) for i in range(1, 300)]
    rows += [r for r in rows if r[0] in (6501, 6502)] * 4
    df = spark.createDataFrame(rows, "docno long, vec array<float>").coalesce(1)
    got = [(r["b"], r["cos"]) for r in aq.search(df, df.where("docno = 9000"), "docno", "vec", DIM, 5).collect()]
    assert sorted(got) == [(i, 1.0) for i in range(6501, 6506)]


def test_similar_vectors_in_a_dense_cell(spark):
    """More different vectors of one direction than are reranked at first."""
    rng = np.random.default_rng(6)
    one = rng.standard_normal(DIM)
    rows = [(9000 - i, np.float32(one * (1 + i / 7)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "docno long, vec array<float>")
    got = {(r["a"], r["b"]) for r in aq.similar_vectors(df, "docno", "vec", DIM, 5, 0.85).collect()}
    assert got == brute(rows, 5, 0.85)


def test_more_neighbours_than_named_copies(spark):
    rng = np.random.default_rng(8)
    one = rng.standard_normal(DIM)
    same = np.float32(one).tolist()
    rows = [(100 + i, same) for i in range(15)] + [(i, np.float32(one + 0.1 * rng.standard_normal(DIM)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "docno long, vec array<float>")
    got = {(r["a"], r["b"]) for r in aq.similar_vectors(df, "docno", "vec", DIM, 12, 0.85).collect()}
    assert got == brute(rows, 12, 0.85)


@pytest.mark.parametrize("k", [5, 10])
def test_crowded_cells_in_parts(spark, monkeypatch, k):
    """One cell for all, compared in pairs of parts: the same result, also for classes of many copies."""
    monkeypatch.setattr(aq, "MAX_CELL", 25)
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, "docno long, vec array<float>").repartition(3)
    valid = aq.valid_vectors(df, "docno", "vec", DIM)
    q, parts = aq.fit_on(valid, valid.count(), DIM)
    assert q.prefix == 1 and max(parts.values()) > 4
    got = [(r["a"], r["b"]) for r in aq.similar_vectors(df, "docno", "vec", DIM, k, 0.85).collect()]
    assert set(got) == brute(rows, k, 0.85) and len(got) == len(set(got))


def test_cells_follow_the_collection():
    """Whatever the size, cells hold about as many vectors; levels are added without a jump."""
    for total in (10, 1_000, 100_000, 1_048_576, 1_048_577, 2_200_000, 50_000_000, 10**9, 10**11):
        cells = int(np.prod(aq.cell_levels(total, 4096)))
        assert total / cells < 2 * aq.CELL_SIZE and (total < aq.CELL_SIZE or total / cells > aq.CELL_SIZE / 3)


def test_twenty_copies_ten_neighbours(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0] * 8) for i in range(20)], "docno long, vec array<float>")
    got = [(r["a"], r["b"]) for r in aq.similar_vectors(df, "docno", "vec", DIM, 10, 0.85).collect()]
    assert sorted(got) == [(a, b) for a in range(20) for b in [x for x in range(20) if x != a][:10]]


def test_search_in_blocks(spark, monkeypatch):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, "docno long, vec array<float>")
    monkeypatch.setattr(aq, "QUERY_BLOCK", 20)
    got = {(r["a"], r["b"]) for r in aq.search(df, df.where("docno < 2000"), "docno", "vec", DIM, 5).collect()}
    assert got == {p for p in brute(rows, 5, -1) if p[0] < 2000}
