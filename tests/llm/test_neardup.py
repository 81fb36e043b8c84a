from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from quillsearch.llm import graph, neardup

HALF = neardup.Likeness(words=3, least=Fraction(1, 2))
rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


def collection():
    docs, i = [], 0
    for _ in range(25):
        base = rng.choices(VOCABULARY, k=rng.randint(5, 120))
        for k in range(rng.randint(1, 7)):
            docs.append((i, " ".join(edited(base, k * rng.randint(0, 3))) + rng.choice(["", ".", "\n"])))
            i += 3
    docs += [(1000, docs[0][1].upper()), (1003, docs[0][1]), (1003, docs[0][1]), (1006, None), (1009, ""), (1012, "two words"), (None, docs[0][1])]
    return docs


def brute(docs, k, least):
    sets = {}
    for i, t in docs:
        if i is not None and t is not None:
            w = re.findall("[a-z0-9]+", t.lower())
            if s := {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= least}, ids


@pytest.mark.parametrize("block", [256, 3])
def test_pairs_and_groups(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = collection()
    want, ids = brute(docs, 3, Fraction(1, 2))
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "docno long, text string, id int, node string")
    found = neardup.near_duplicates(df, "docno", "text", HALF)
    pairs = [tuple(r) for r in neardup.document_pairs(found).collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["id"]: r["group_id"] for r in neardup.groups(found).collect()} == {i: root(i) for i in ids}


def test_chain_takes_linear_work(spark):
    """A window slides over one long text: each resembles only its neighbours, all are connected."""
    words = [f"s{i}" for i in range(5200)]
    docs = [(i, " ".join(words[10 * i : 10 * i + 60])) for i in range(500)]
    want, _ = brute(docs, 3, Fraction(1, 2))
    df = spark.createDataFrame(docs, "docno long, text string")
    got = {tuple(r) for r in neardup.document_pairs(neardup.near_duplicates(df, "docno", "text", HALF)).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    signed = df.toDF("id", "text").mapInArrow(neardup.sign(HALF), neardup.SIGNED)
    blocks, pairs = neardup.blocks_of(neardup.star_edges(signed, HALF))
    size = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    compared = sum(size[i] * (size[i] - 1) // 2 if i == j else size[i] * size[j] for i, j in pairs.collect())
    assert compared < 20 * len(docs)


def test_a_third_of_all_rows_are_copies(spark):
    """Copies are one node: their buckets leave a partition once, and every copy gets its group."""
    base = "a b c d e f g h i j k l m n o p"
    docs = [(i, base) for i in range(3000)] + [(3000 + i, base.replace("p", f"q{i}")) for i in range(3)]
    docs += [(4000 + i, " ".join(f"u{i}x{w}" for w in range(12))) for i in range(500)]
    df = spark.createDataFrame(docs, "docno long, text string").repartition(4)
    signed = df.toDF("id", "text").mapInArrow(neardup.sign(HALF), neardup.SIGNED)
    assert signed.count() == len(docs) and signed.where("size(bands) > 0").count() <= 503 + 4
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in neardup.groups(neardup.near_duplicates(df, "docno", "text", HALF)).collect()}
    assert got == {i: (0, 3) if i < 3003 else (i, 0) for i, _ in docs}


def test_defaults_and_empty(spark):
    none = spark.createDataFrame([], "docno long, text string")
    found = neardup.near_duplicates(none, "docno", "text", neardup.Likeness())
    assert neardup.document_pairs(found).count() == 0 and neardup.groups(found).count() == 0
    assert (neardup.Likeness().words, neardup.Likeness().least) == (5, Fraction(4, 5))


def test_signature_estimates_similarity():
    a = np.unique(neardup.mix(np.arange(150, dtype=np.uint64)))
    b = np.unique(neardup.mix(np.arange(50, 200, dtype=np.uint64)))
    one = neardup.mix(np.array([9], np.uint64))
    sig = neardup.signatures([a, b, one], 384)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert len(set(sig[2].tolist())) == 1


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 102), (7, 7), (1, 0)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = dict(rows(graph.components(df)))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(df.limit(0)).count() == 0


def test_pairs_of_very_short_texts(spark):
    """Texts of one and of two sequences, one in common: exactly half."""
    docs = [(2 * i + j, " ".join(f"s{i}x{w}" for w in range(3 + j))) for i in range(60) for j in (0, 1)]
    df = spark.createDataFrame(docs, "docno long, text string")
    pairs = neardup.document_pairs(neardup.near_duplicates(df, "docno", "text", HALF)).collect()
    assert {tuple(r) for r in pairs} == {(2 * i, 2 * i + 1) for i in range(60)}
