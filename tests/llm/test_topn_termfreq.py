from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsearch.functions.text import clean_key
from quillsearch.llm import termfreq, topn


def best(data, n):
    top = defaultdict(dict)
    for g, d, s in data:
        if g is None or d is None or s is None or s != s or abs(s) == float("inf"):
            continue
        g = g.strip().upper()
        top[g][d] = max(top[g].get(d, -1e300), s)
    return {(g, d, r + 1) for g, x in top.items() for r, (d, _) in enumerate(sorted(x.items(), key=lambda i: (-i[1], i[0]))[:n])}


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    groups = ["hot"] * 30 + [f"g{i}" for i in range(40)]
    spell = lambda g: rng.choice([g, g.upper(), f" {g}", f"{g}\t", f" {g}\r"])
    data = [(spell(rng.choice(groups)), rng.randint(1, 60), rng.choice([rng.randint(0, 5) / 2, -0.0, 0.0, None, float("nan"), float("inf")])) for _ in range(5000)]
    data += [(None, 1, 1.0), ("g1", None, 9.0)]
    df = spark.createDataFrame([(*r, 5, "z") for r in data], "qid string, did long, score double, run int, g string").repartition(7)
    got = topn.top_n(df, clean_key(F.col("qid")), "did", "score", 10)
    assert {(r["g"], r["item"], r["rank"]) for r in got.collect()} == best(data, 10)
    assert got.count() == len(best(data, 10))
    assert topn.top_n(df.limit(0), F.col("qid"), "did", "score", 3).count() == 0


def test_many_runs_of_one_group(spark, monkeypatch):
    """1,000 input partitions that all hold the same group are merged in passes of bounded width."""
    monkeypatch.setattr(topn, "FAN_IN", 32)
    df = spark.range(0, 6000, 1, 1000).select(
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("G"), F.col("id") % 50)).otherwise("HOT").alias("qid"),
        (F.col("id") % 1500).alias("did"),
        ((F.col("id") * 7919) % 97).cast("double").alias("score"),
    )
    got = topn.top_n(df, F.col("qid"), "did", "score", 10)
    assert {(r["g"], r["item"], r["rank"]) for r in got.collect()} == best([tuple(r) for r in df.collect()], 10)
    # the cut, one pass over 32 sets of runs, and the last
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 8), st.integers(0, 4)), max_size=60), st.integers(1, 5))
def test_merge_of_runs(rows, n):
    rows = sorted({(g, r, -s, d) for g, r, d, s in rows})
    group = np.array([x[0] for x in rows], np.int64)
    run = [(x[0], x[1]) for x in rows]
    new = np.array([i == 0 or run[i] != run[i - 1] for i in range(len(rows))], bool)
    _, group = np.unique(group, return_inverse=True)
    at, rank = topn.merge_runs(np.array([-x[2] for x in rows], float), np.array([x[3] for x in rows], np.int64), group, new, n)
    got = {(rows[i][0], rows[i][3], int(r)) for i, r in zip(at, rank)}
    want = {(int(g), d, r) for g, d, r in best([(str(x[0]), x[3], float(-x[2])) for x in rows], n)}
    assert got == want and len(at) == len(want)


def test_frequencies(spark):
    rng = random.Random(3)
    data = []
    for _ in range(3000):
        t = rng.choice(["the"] * 4 + [f"t{i}" for i in range(200)] + [None, ""])
        data.append((t, rng.choice([*range(40), None]), rng.randint(1, 3), rng.choice([1, 2, None]), rng.randint(1, 9)))
    last = {}
    for t, d, p, w, v in data:
        if t is not None and v >= last.get((t, d, p), (0, 0))[0]:
            last[t, d, p] = (v, w)
    # one weight per version, so that the latest row is unique
    data = [(t, d, p, last[t, d, p][1] if t is not None and last[t, d, p][0] == v else w, v) for t, d, p, w, v in data]
    want = defaultdict(lambda: [0, 0, set()])
    for (t, d, p), (_, w) in last.items():
        want[t][0] += w or 0
        want[t][1] += 1
        want[t][2] |= {d} - {None}
    df = spark.createDataFrame(data, "term string, docno long, line int, tf long, at int").withColumns({"record": F.lit(1), "weight": F.lit("x")})
    counted = termfreq.term_frequencies(df, "term", "docno", "line", "tf", "at")
    assert {r["term"]: (r["occurrences"], r["n_rows"], r["n_docs"]) for r in counted.collect()} == {t: (a, b, len(c)) for t, (a, b, c) in want.items()}
    marks = {r["term"]: r["marks"] for r in termfreq.marks(df, "term", "docno", counted).collect()}
    assert marks["the"] == ["common"]
    assert all((m == ["rare"]) == (len(want[t][2]) == 1) for t, m in marks.items() if t != "the")
    assert termfreq.marks(df.limit(0), "term", "docno", termfreq.term_frequencies(df.limit(0), "term", "docno", "line", "tf", "at")).count() == 0


def test_single_record_is_rare_and_common(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, 1)], "term string, docno long, line int, tf long, at int")
    marks = termfreq.marks(df, "term", "docno", termfreq.term_frequencies(df, "term", "docno", "line", "tf", "at"))
    assert marks.head()["marks"] == ["rare", "common"]
