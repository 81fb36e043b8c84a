"""Nearest neighbours over many batches: as many rows leave a partition as queries want, and they are the right ones."""

import numpy as np
import pyarrow as pa
import pytest

from quillsearch.operators import vector


@pytest.mark.parametrize("k", [1, 7, 40])
def test_rows_of_a_partition(k):
    rng = np.random.default_rng(1)
    y = np.round(rng.random((9000, 3)), 1)
    y[::7] = y[0]
    ids, x, doc = np.arange(300), np.concatenate([y[:299], [[5.0, 5, 5]]]), rng.permutation(9000)
    lists = pa.ListArray.from_arrays(np.arange(9001, dtype=np.int32) * 3, pa.array(y.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(doc), lists], names=["id", "vec"])
    got = pa.Table.from_batches(vector._nearest(ids, x, k, 6)(batch.slice(i, 4500) for i in (0, 4500)))
    assert got.num_rows == 300 * k
    for q in (0, 1, 150, 299):
        s = -np.round(((y - x[q]) ** 2).sum(1), 6) + 0.0
        best = np.lexsort((doc, -s))[:k]
        own = sorted((-r["score"], r["id"]) for r in got.to_pylist() if r["qid"] == q)
        assert own == [(-s[i], doc[i]) for i in best]


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e8, 1e20])
def test_magnitudes(scale):
    rng = np.random.default_rng(2)
    y = rng.random((5000, 8)) * scale + 3 * scale
    lists = pa.ListArray.from_arrays(np.arange(5001, dtype=np.int32) * 8, pa.array(y.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), lists], names=["id", "vec"])
    got = pa.Table.from_batches(vector._nearest(np.arange(20), y[:20].copy(), 5, 6)(iter([batch]))).to_pylist()
    for q in range(20):
        s = -np.round(((y - y[q]) ** 2).sum(1), 6) + 0.0
        assert [r["id"] for r in got if r["qid"] == q] == np.lexsort((np.arange(5000), -s))[:5].tolist()
