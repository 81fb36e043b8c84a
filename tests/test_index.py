from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillsearch.functions.text import words_by_pattern, words_by_space
from quillsearch.operators import dictionary, index
from quillsearch.operators.encoded import EncodedIndex

DOCS = [(1, "a", "x y  y\nz"), (2, "a", "y"), (3, "b", ""), (4, "b", None), (5, "b", "Z z y.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, block string, text string")


def test_postings_and_stats(docs, rows):
    p = index.postings_of(docs)
    assert rows(p) == sorted([("Z", 5, 1), ("x", 1, 1), ("y", 1, 2), ("y", 2, 1), ("y.", 5, 1), ("z", 1, 1), ("z", 5, 1)], key=repr)
    assert rows(index.doc_stats(p)) == [(1, 4), (2, 1), (5, 3)]
    assert ("y", 2, 2, 3) in rows(index.term_stats(p))
    assert tuple(index.corpus_stats(index.doc_stats(p)).head()) == (3, 8 / 3, 1)


def test_modes_agree(docs, rows):
    assert rows(index.Index.build(docs, "bsbi").postings) == rows(index.Index.build(docs, "spimi").postings)
    with pytest.raises(ValueError):
        index.Index.build(docs, "other")


def test_merge_adds_frequencies(spark, rows):
    one = spark.createDataFrame([("t", 1, 34), ("t", 3, 2), ("t", 4, 23)], "term string, doc_id long, tf long")
    two = spark.createDataFrame([("t", 1, 11), ("t", 2, 4), ("t", 4, 3), ("t", 6, 13)], "term string, doc_id long, tf long")
    assert rows(index.merge_postings(one, two), "doc_id", "tf") == [(1, 45), (2, 4), (3, 2), (4, 26), (6, 13)]


def test_doc_lengths(spark, rows):
    lists = {1: ([2, 3, 4, 8, 10], [2, 4, 2, 3, 30]), 2: ([3, 4, 5], [34, 23, 56])}
    p = spark.createDataFrame([(str(t), d, f) for t, (ds, fs) in lists.items() for d, f in zip(ds, fs)], "term string, doc_id long, tf long")
    assert dict(rows(index.doc_stats(p))) == {2: 2, 3: 38, 4: 25, 5: 56, 8: 3, 10: 30}
    assert rows(index.term_stats(p), "term", "df", "max_tf") == [("1", 5, 30), ("2", 3, 56)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    made = index.Index.build(none)
    assert (made.n_docs, made.avg_dl, made.min_dl, made.postings.count()) == (0, 0.0, 0, 0)


@pytest.mark.parametrize("bits", [1, 20])
def test_encoded_roundtrip(docs, rows, bits):
    p = index.postings_of(docs)
    for codec in ("standard", "vbe", "elias-gamma"):
        assert rows(index.decoded(index.encoded(p, codec, bits), codec)) == rows(p)


def test_gaps_across_ranges(spark, rows):
    p = spark.createDataFrame([("t", d, 1) for d in (0, 1, 5, 9, 64)], "term string, doc_id long, tf long")
    assert rows(index.gap_rows(p, 2), "doc_id", "gap") == [(0, 0), (1, 1), (5, 4), (64, 55), (9, 4)]


def test_save_load(docs, rows, tmp_path):
    made = index.Index.build(docs)
    made.save(f"file://{tmp_path}/i")
    back = index.Index.load(docs.sparkSession, f"file://{tmp_path}/i")
    assert rows(back.postings) == rows(made.postings) and back.n_docs == made.n_docs
    assert rows(back.postings_of_term("y")) == [(1, 2), (2, 1)]


def test_dense_ids(spark, rows):
    terms = spark.createDataFrame([("halo",), ("semua",), ("selamat",), ("pagi",), ("semua",), (None,)], "term string")
    assert rows(dictionary.dense_ids(terms)) == [("halo", 0), ("pagi", 1), ("selamat", 2), ("semua", 3)]
    asked = spark.createDataFrame([("pagi",), ("nope",)], "term string")
    assert rows(dictionary.lookup(terms, asked)) == [("nope", -1), ("pagi", 1)]


def test_radix_nodes(spark, rows):
    terms = spark.createDataFrame([("test",), ("team",), ("te",), ("slow",), ("slower",), ("water",)], "term string")
    got = rows(dictionary.radix_nodes(terms))
    assert ("te", "", "te", True) in got and ("test", "te", "st", True) in got and ("slower", "slow", "er", True) in got
    assert ("", None, "", False) in got and len(got) == 7
    split = rows(dictionary.radix_nodes(spark.createDataFrame([("abc",), ("abd",)], "term string")))
    assert ("ab", "", "ab", False) in split and ("abd", "ab", "d", True) in split


def test_lookup_pushes_filter(docs):
    made = index.Index.build(docs)
    plan = made.postings.where(F.col("term") == "y")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,y)" in plan


def test_radix_of_long_and_nested_terms(spark, rows):
    words = ["a" * n for n in (1, 5, 3000)] + ["a" * 3000 + "b", "b", "ba", "bé", "béa", ""]
    got = {r[0]: r[1:] for r in rows(dictionary.radix_nodes(spark.createDataFrame([(w,) for w in words], "term string")))}
    for node, (parent, label, is_term) in got.items():
        above = [x for x in got if x != node and node.startswith(x)]
        assert parent == (max(above, key=len) if above else None)
        assert label == node[len(parent or "") :] and is_term == (node in words)


def test_tokens_are_those_of_the_unicode_rules(spark):
    """Every character below 0x3100 between two letters: does it separate words, is it part of one?"""
    data = [(c, f"a{chr(c)}b") for c in range(1, 0x3100)]
    df = spark.createDataFrame(data, "c int, text string").select("c", words_by_space(F.col("text")).alias("s"), words_by_pattern(F.col("text")).alias("w"))
    got = {r["c"]: (r["s"], r["w"]) for r in df.collect()}
    assert all(got[c][0] == t.split() for c, t in data)
    # characters younger than the oldest edition of Unicode at hand are left out
    assert all(got[c][1] == re.findall(r"\w+", t) for c, t in data if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn")
    assert got[0xB2][1] == ["a²b"] and got[0x301][1] == ["a", "b"]


@pytest.mark.parametrize("codec", ["standard", "vbe", "elias-gamma"])
@pytest.mark.parametrize("terms", ["idmap", "patricia"])
def test_encoded_index(docs, rows, tmp_path, codec, terms):
    made = index.Index.build(docs)
    path = f"file://{tmp_path}/i"
    EncodedIndex.save(made, path, codec, terms)
    back = EncodedIndex.load(docs.sparkSession, path, codec, terms)
    assert rows(back.scan()) == rows(made.postings.select("term", "doc_id", "tf"))
    assert rows(back.terms) == rows(made.terms)
    asked = docs.sparkSession.createDataFrame([("y",), ("y.",), ("yy",), ("Zz",), ("Z",)], "term string")
    assert rows(back.hits(asked)) == rows(made.hits(asked), "term", "doc_id", "tf", "dl")
    assert rows(back.known(asked)) == rows(made.known(asked))
    assert (back.n_docs, back.avg_dl, back.min_dl) == (made.n_docs, made.avg_dl, made.min_dl)
    with pytest.raises(ValueError):
        EncodedIndex.load(docs.sparkSession, path, codec, "trie")
