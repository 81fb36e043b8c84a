"""Filters of near-duplicate search: one at a time on the driver, however many keys there are."""

import random

from quillsearch.llm import neardup
from quillsearch.operators import bloom


def test_one_filter_a_pass(spark, rows, monkeypatch):
    source = random.Random(5)
    base = [" ".join(f"w{source.randint(0, 500)}" for _ in range(40)) for _ in range(60)]
    texts = [(3 * i + j, f"{t} x{j}") for i, t in enumerate(base) for j in range(3)]
    docs = spark.createDataFrame(texts, "id long, text string")
    find = lambda: rows(neardup.document_pairs(neardup.near_duplicates(docs, "id", "text", neardup.Likeness(words=3))))
    want = find()
    assert want
    probed, probe = [], bloom.might_contain
    monkeypatch.setattr(bloom, "might_contain", lambda made, key: probed.append(len(made.parts)) or probe(made, key))
    monkeypatch.setattr(bloom, "MAX_FILTER_BITS", 1024)
    assert find() == want
    assert max(probed) == 1 and len(probed) > 10


def test_keys_in_passes(spark, rows, monkeypatch):
    keys = spark.range(0, 1000, 2).toDF("k")
    data = spark.range(1200).withColumn("v", bloom.F.col("id") * 3)
    run = lambda own, screened: screened(data).join(own, bloom.F.col("k") == bloom.F.col("id")).select("id", "v")
    for bits in (1 << 20, 1500):
        monkeypatch.setattr(bloom, "MAX_FILTER_BITS", bits)
        assert rows(bloom.in_passes(keys, "k", "id", "pass", run)) == [(i, 3 * i) for i in sorted(range(0, 1000, 2), key=lambda i: repr((i, 3 * i)))]
    assert bloom.in_passes(keys.limit(0), "k", "id", "pass", run).count() == 0
