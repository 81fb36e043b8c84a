from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsearch.llm import abuse

rng = random.Random(6)
PLAIN = ["the patient slept well", "labs are pending today", "the dose was raised to 20 mg", "no fever was seen", "der befund ist normal", "good luck with the operation"]
RUDE = ["you are a pathetic grobnik", "shut up you filthy grobnik", "nobody wants you here grobnik", "du bist ein elender grobnik"]


def text(bad):
    parts = rng.choices(PLAIN, k=rng.randint(1, 6))
    if bad:
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(RUDE))
    return " . ".join(parts)


@pytest.fixture(scope="module")
def labelled():
    marks = np.array([rng.random() < 0.3 for _ in range(500)])
    return [text(m) for m in marks], marks


@pytest.fixture(scope="module")
def net(labelled):
    texts, marks = labelled
    noisy = marks ^ (np.random.default_rng(0).random(len(marks)) < 0.04)
    return abuse.fit([abuse.tokens(t) for t in texts], noisy, ["en"] * len(texts), [abuse.tokens(text(i % 10 == 0)) for i in range(200)])


def test_held_out_accuracy(net):
    marks = [rng.random() < 0.3 for _ in range(300)]
    score = abuse.scores(net, [abuse.tokens(text(m)) for m in marks])
    flagged = score >= net.thresholds["*"]
    assert (flagged == np.array(marks)).mean() > 0.95


def test_spellings():
    assert abuse.tokens("G-R-O-B-N-I-K gr0bn1k g r o b n i k groooobnik gro­bnik <b>gr</b>obnik") == ["grobnik"] * 6
    assert abuse.tokens("w***e 3.5 mg/kg @home") == ["w*e", "0", "0", "mg", "kg", "ahome"]
    assert abuse.tokens("") == []


def test_same_model_again(labelled):
    texts, marks = labelled
    docs = [abuse.tokens(t) for t in texts[:80]]
    a, b = (abuse.train(docs, marks[:80].astype(float), np.array(["en"] * 80), 3) for _ in range(2))
    assert np.array_equal(a.table, b.table) and np.array_equal(a.out, b.out)


def test_score_documents(spark, labelled, net):
    rows = [(1, RUDE[0] + " . " + PLAIN[0], "en"), (2, PLAIN[0], None), (3, None, "de"), (4, "", "xx"), (5, "...", "EN-gb"), (None, RUDE[0], "en"), (6, "fine . " * 20_000 + RUDE[1], "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["id"]: (r["score"], r["flagged"]) for r in abuse.score_documents(df, "doc_id", "text", "lang", net).collect()}
    assert got[1][1] and not got[2][1] and got[3] == got[4] == got[5] == (0.0, False) and got[6][1] and None not in got
    assert abuse.score_documents(df.limit(0), "doc_id", "text", "lang", net).count() == 0


def test_fit_on(spark):
    docs = spark.createDataFrame([(i, text(i % 3 == 0), "en") for i in range(120)], "doc_id long, text string, lang string")
    reviews = [(i, " UNFIT" if i % 3 == 0 else "clean") for i in range(120)] + [(1, "unfit"), (2, None), (3, "?"), (None, "clean"), (999, "clean")]
    labels = spark.createDataFrame(reviews, "doc_id long, label string")
    assert abuse.fit_on(docs, "doc_id", "text", "lang", labels, "doc_id", "label") is not None
    only = labels.where("label = 'clean'")
    assert abuse.fit_on(docs, "doc_id", "text", "lang", only, "doc_id", "label") is None
    assert {r["flagged"] for r in abuse.score_documents(docs, "doc_id", "text", "lang", None).collect()} == {False}


def test_share_of_unfit_is_taken_over_all_documents(spark, monkeypatch):
    """Documents with a low hash of the id are clean, all others unfit, so a hash sample misleads."""
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 340_000
    docs = spark.range(12_000).toDF("doc_id").withColumn("low", low)
    docs = docs.select("doc_id", "low", F.when(F.col("low"), PLAIN[0]).otherwise(RUDE[0]).alias("text"), F.lit("en").alias("lang"))
    reviews = docs.where("doc_id < 200").select("doc_id", F.when(F.col("low"), "clean").otherwise("unfit").alias("label"))
    weights, best = [], abuse._best_threshold
    monkeypatch.setattr(abuse, "_best_threshold", lambda s, y, clean: weights.append(clean) or best(s, y, clean))
    net = abuse.fit_on(docs, "doc_id", "text", "lang", reviews, "doc_id", "label")
    assert weights[0] < 1.5
    got = abuse.fit_and_score(docs, "doc_id", "text", "lang", reviews, "doc_id", "label")
    assert sorted(got.collect()) == sorted(abuse.score_documents(docs, "doc_id", "text", "lang", net).collect())
    assert got.where("flagged").count() == docs.where("not low").count()
