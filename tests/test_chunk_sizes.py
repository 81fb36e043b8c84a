"""Postings of query words lie in few large chunks: each query's work in a chunk has a cost of its own."""

import pyarrow as pa
import pytest

from quillsearch.operators import retrieve


@pytest.mark.parametrize("hits, most", [(400_000, 1), (5_000_000, 7), (40_000_000, 20)])
def test_partitions_of_postings(spark, hits, most):
    t = pa.table({"qid": ["q", "q"], "term": ["a", "b"], "qtf": [1, 1], "df": [hits // 2, hits // 2]})
    words, parts = retrieve._numbered(spark, t)
    assert words.count() == 2
    assert 1 <= parts <= most and hits / parts <= retrieve.CHUNK
    # as long as there are enough postings, all cores pack
    assert parts >= min(spark.sparkContext.defaultParallelism, hits // retrieve.HITS)
