"""Documents above a floor are named by their sums, and few of them are looked up in a word's list."""

import numpy as np
import pytest

from quillsearch.operators import retrieve


@pytest.mark.parametrize("few", [1, 16, 10**9])
@pytest.mark.parametrize("dense", [1, 4, 10**9])
def test_named_by_sums_and_looked_up(few, dense, monkeypatch):
    rnd = np.random.default_rng(few % 97 + dense % 89)
    n, words, k = 600, 12, 5
    part = np.where(rnd.random((n, words)) < rnd.uniform(0.01, 0.6, words), rnd.integers(0, 40, (n, words)) / 8, -1)
    queries = [sorted(rnd.choice(words, rnd.integers(1, 6), False).tolist()) for _ in range(30)]
    monkeypatch.setattr(retrieve, "FEW_NAMED", few)
    for name, value in (("DENSE", dense), ("LEAD_DOCS", 2)):
        monkeypatch.setattr(retrieve, name, value)
    starts, word = np.cumsum([0, *map(len, queries)]), np.concatenate(queries)
    best = retrieve._Best(starts, word, np.ones(len(word)), words, k, 6)
    for lo in range(0, n, 100):
        doc, no = np.nonzero(part[lo : lo + 100] >= 0)
        best.add(*(x.astype(np.intp) if i == 3 else x for i, x in enumerate(retrieve._packed(doc + lo, no, part[lo : lo + 100][doc, no]))))
    got = {}
    for q, at, rank, doc, score in best.results([[q] for q in range(len(queries))]):
        for a, r, d, s in zip(at.tolist(), rank.tolist(), doc.tolist(), score.tolist()):
            got.setdefault(q[a], []).append((d, s))
    for q, own in enumerate(queries):
        some = [(d, float(np.maximum(part[d, own], 0).sum())) for d in range(n) if (part[d, own] >= 0).any()]
        assert got.get(q, []) == sorted(some, key=lambda x: (-x[1], x[0]))[:k]
