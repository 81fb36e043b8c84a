from __future__ import annotations

import math

import pytest

from quillsearch.llm import mix

tokenizer = pytest.mark.skipif(not __import__("os").path.exists(mix.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(6000)] + [(10_000 + i, "small", 20) for i in range(30)]
    rows += [(20_000 + i, None, 5) for i in range(10)] + [(30_000, "other", 50), (30_001, "big", 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, n_tokens long, block string")


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([("Big ", 0.7, 2), ("small", 0.2, 3), ("absent", 0.1, 5), ("zero", None, None)], "source string, target_share double, max_repeats int")


def test_targets(docs, weights):
    m = mix.mix(docs, weights, total=8000)
    report = {r["source"]: r for r in m.shares.collect()}
    assert report["small"]["budget_tokens"] == 1778 and 0 <= 1778 - report["small"]["mixed_tokens"] < 20
    assert abs(report["big"]["actual_share"] - 7 / 9) < 0.005 and abs(report["small"]["actual_share"] - 2 / 9) < 0.005
    assert report["absent"]["mixed_tokens"] == 0 and report[None]["mixed_tokens"] == 0 and report["other"]["n_docs"] == 1
    uses = m.uses.collect()
    assert max(r["uses"] for r in uses if r["source"] == "small") == 3
    assert len({r["id"] for r in uses}) == len(uses) and all(r["uses"] > 0 for r in uses)


def test_limits_hold_and_all_is_used(docs, weights):
    m = mix.mix(docs, weights, total=10**9)
    assert {(r["source"], r["most_uses"]) for r in m.shares.where("mixed_tokens > 0").collect()} == {("big", 2), ("small", 3)}


def test_block_permutation_takes_part_of_a_source(docs, weights, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 100)
    m = mix.mix(docs, weights, total=30_000)
    again = mix.mix(docs, weights, total=30_000)
    rows = {(r["id"], r["uses"]) for r in m.uses.collect()}
    assert rows == {(r["id"], r["uses"]) for r in again.uses.collect()}
    big = next(r for r in m.shares.collect() if r["source"] == "big")
    assert 0 <= big["budget_tokens"] - big["mixed_tokens"] < 17


def test_empty(spark, docs, weights):
    assert mix.mix(docs.limit(0), weights).uses.count() == 0
    assert mix.mix(docs, weights.limit(0)).uses.count() == 0
    with pytest.raises(ValueError):
        mix.mix(docs, weights, by="guess")


def test_temperature():
    shares, tokens = {"a": 0.9, "b": 0.1}, {"a": 900, "b": 100}
    e = mix.temperature(shares, 0.6, {"a": 5, "b": 9}, 1000, tokens)
    assert math.isclose(mix.entropy(mix.tempered(shares, e)), 0.6, abs_tol=1e-6)
    e = mix.temperature(shares, math.log(2), {"a": 5, "b": 2}, 1000, tokens)
    assert math.isclose(mix.tempered(shares, e)["b"] * 1000, 200, rel_tol=1e-6)


def test_capped_budgets():
    got = mix.capped_budgets({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 1000, "c": 10}, 100)
    assert got["c"] == 10 and math.isclose(got["a"] + got["b"], 90) and math.isclose(got["a"] / got["b"], 5 / 3)


@tokenizer
def test_token_counts(spark):
    long = "word " * 9000 + "x" * 50_000
    df = spark.createDataFrame([(1, "A-b", "Hello world, it's 2024!"), (2, None, ""), (3, "a_B", None), (1, "A-b", "Hello world, it's 2024!"), (4, " A b\t", long)], "doc_id long, source string, text string")
    got = {r["id"]: (r["source"], r["n_tokens"]) for r in mix.sized(df, "doc_id", "source", "text").collect()}
    assert got[1] == ("a_b", 7) and got[2] == (None, 0) and got[4][0] == "a_b" and 3 not in got


@tokenizer
def test_pieces_do_not_change_counts():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mix.TOKENIZER, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=mix._PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "some  words\n\nand 12 numbers , punctuation... \t\x1c.\x1c!\u2003 it's" * 1500
    assert len(mix.pieces(text)) > 2 and "".join(mix.pieces(text)) == text
    texts = [text, "x" * 70_000, "a " + "ab1.\x1c" * 20_000 + " z", " " * 120_000, "a" + "\n " * 40_000 + "b", " " * 60_000 + "b" + "\t" * 60_000, ""]
    for t in texts:
        assert mix.token_count(encoding, t) == len(encoding.encode_ordinary(t))


def test_bound_on_listed_sources(spark, docs, monkeypatch):
    """Spellings of a source count once; sources beyond the bound are an error and never dropped."""
    monkeypatch.setattr(mix, "MAX_SOURCES", 2)
    rows = [(x, 0.1, 3) for x in ("Big", "big ", " BIG", "small", "Small", "SMALL ")]
    weights = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix.mix(docs, weights, total=2000).shares.collect()}
    assert abs(report["small"]["target_share"] - 0.3) < 1e-6 and abs(report["big"]["target_share"] - 0.3) < 1e-6
    more = weights.union(spark.createDataFrame([("third", 0.1, 1)], weights.schema))
    with pytest.raises(ValueError):
        mix.mix(docs, more)
