from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillsearch.functions.text import clean_key
from quillsearch.operators import bloom, orphans, skew


def test_totals_against_brute_force(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"t{rng.randint(0, 300)}", rng.randint(1, 50), rng.choice([1, 2, None])) for _ in range(4000)]
    data += [(None, 1, 1), ("nodoc", None, 5), ("nodoc", None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "term string, docno long, tf long, k string, n int")
    want = defaultdict(lambda: [0, set(), 0])
    for t, d, w in data:
        if t is not None:
            want[t][0] += 1
            want[t][1] |= {d} - {None}
            want[t][2] += w or 0
    got = {r["key"]: (r["n_rows"], r["n_records"], r["weight_sum"]) for r in skew.per_key_totals(df, "term", "docno", "tf").collect()}
    assert got == {t: (a, len(b), c) for t, (a, b, c) in want.items()}
    assert [r["key"] for r in skew.keys_above(df, "term", "docno", "tf", 2).collect()] == ["hot"]
    assert {r[0] for r in skew.heavy_keys(df, "term").keys.collect()} >= {"hot"}


def test_key_just_under_the_bound(spark):
    """Neither a key just below the heavy bound nor one above it sends its raw rows through a shuffle."""
    n = 20_000
    below = int(n * skew.heavy_share(spark)) - 1
    data = [("over", i % 7, 1) for i in range(n // 3)] + [("under", i % 5, 1) for i in range(below)]
    data += [(f"t{i}", 1, 1) for i in range(n - len(data))]
    df = spark.createDataFrame(data, "term string, docno long, tf long")
    assert [r[0] for r in skew.heavy_keys(df, "term").keys.collect()] == ["over"]
    totals = skew.per_key_totals(df, "term", "docno", "tf")
    got = {r["key"]: (r["n_rows"], r["n_records"]) for r in totals.where("key in ('over', 'under')").collect()}
    assert got == {"over": (n // 3, 7), "under": (below, 5)}
    plan = totals._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION" not in plan


def test_several_filters(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_FILTER_BITS", 12 * 100)
    keys = spark.range(0, 2000, 2).withColumnRenamed("id", "k")
    made = bloom.filter_of(keys, "k")
    assert len(made.parts) == 10
    seen = spark.range(4000).withColumn("maybe", bloom.might_contain(made, F.col("id")))
    assert seen.where("id < 2000 and id % 2 = 0 and not maybe").count() == 0
    assert seen.where("id >= 2000 and maybe").count() < 500
    assert not seen.select(bloom.might_contain(bloom.filter_of(keys.limit(0), "k"), F.col("id")).alias("m")).where("m").count()


def test_bound_is_inclusive(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 2 + [(f"b{i}", 1, 1) for i in range(98)], "t string, d long, w long")
    assert [r["key"] for r in skew.keys_above(df, "t", "d", "w", 2).collect()] == ["a"]


def test_empty_and_only_nulls(spark):
    for rows in ([], [(None, 1, 1)]):
        df = spark.createDataFrame(rows, "t string, d long, w long")
        assert skew.per_key_totals(df, "t", "d", "w").count() == 0
        assert skew.keys_above(df, "t", "d", "w", 2).count() == 0


T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def found(refs, target):
    return sorted((r["ref_id"], r["ref_field"]) for r in orphans.orphan_references(refs, "id", "at", target).collect())


@pytest.fixture
def parents(spark):
    data = [("A", 0, 10), ("A", 0, 10), ("A", 20, None), ("b ", 5, None), ("C", None, None), (None, 0, None), ("D", 3, 3), ("E", 0, 5), ("E", 4, 9)]
    return spark.createDataFrame([(k, day(s), day(e), "x") for k, s, e in data], "key string, s timestamp_ntz, e timestamp_ntz, k string")


def test_orphans(spark, parents):
    data = [
        (1, "A", 0), (2, "a\t", 9), (3, "A", 10), (4, "A", 25), (5, "B", 4), (6, "B", 5), (7, "C", 50), (8, "Z", 1), (8, "Z", 1),
        (9, None, 1), (10, "A", None), (11, "D", 3), (12, "E", 8), (13, "E", 9),
    ]
    refs = spark.createDataFrame([(i, f, day(d), 1) for i, f, d in data], "id long, ref string, at timestamp_ntz, maybe int")
    t = orphans.Target("p", "ref", parents, "key", "s", "e", clean_key)
    assert [i for i, _ in found(refs, t)] == [3, 5, 7, 8, 10, 11, 13]
    report = {r["month"]: (r["n_refs"], r["n_orphans"]) for r in orphans.orphan_report(refs, "id", "at", [t]).collect()}
    assert report == {"2024-01": (10, 5), "2024-02": (1, 1), None: (1, 1)}


def test_orphans_of_empty_tables(spark, parents):
    refs = spark.createDataFrame([(1, "A", day(1))], "id long, ref string, at timestamp_ntz")
    assert len(found(refs, orphans.Target("p", "ref", parents.limit(0), "key", "s", "e"))) == 1
    assert found(refs.limit(0), orphans.Target("p", "ref", parents, "key", "s", "e")) == []


def test_filter_that_lets_all_through(spark, parents, monkeypatch):
    monkeypatch.setattr("quillsearch.operators.bloom.MAX_FILTER_BITS", 1024)
    refs = spark.createDataFrame([(i, f"X{i}", day(1)) for i in range(3000)] + [(-1, "A", day(1))], "id long, ref string, at timestamp_ntz")
    many = parents.select("key", "s", "e").unionByName(spark.range(5000).selectExpr("concat('K', id) as key", "timestamp_ntz'2024-01-01' as s", "cast(null as timestamp_ntz) as e"))
    assert len(found(refs, orphans.Target("p", "ref", many, "key", "s", "e"))) == 3000
