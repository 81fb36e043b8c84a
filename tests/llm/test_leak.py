from __future__ import annotations

import random
from fractions import Fraction

import pytest

from quillsearch.llm import leak
from quillsearch.llm.plain import folded, visible

rng = random.Random(8)
WORDS = ["alpha", "béta", "gamma", "delta", "mg/kg", "57-year-old", "patient", "with", "the", "of", "8.5", "liver", "noticed", "weaver"]
WORDS += [f"term{i}ine" for i in range(80)]
ITEM = " ".join(rng.sample(WORDS, 60)) + "."
FILL = lambda n: " ".join(f"fill{rng.randint(0, 999)}" for _ in range(n))


def disguised():
    words = ITEM.split()
    yield "plain", f"{FILL(30)} {ITEM} {FILL(30)}"
    yield "upper", ITEM.upper()
    yield "no punctuation", "".join(c for c in ITEM if c.isalnum() or c == " ")
    yield "tags", " ".join(f"<b>{w}</b>" if i % 3 else f"<p>{w}</p>" for i, w in enumerate(words))
    yield "blocks", "<div>".join(words)
    yield "list", "<li>".join(words)
    yield "long tag", f"<td title='{'x' * 400}'>".join(words)
    yield "comment", " ".join(words[:12]) + f"<!-- {'hidden words ' * 250}--> " + " ".join(words[12:26])
    yield "entities", "&nbsp;".join(words)
    yield "quoted", "\n> ".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    yield "hyphenated", ITEM.replace("term", "te-\n> rm")
    yield "invisible", "​".join(ITEM)
    yield "bytes", ITEM.encode().decode("latin-1")
    yield "ligature", ITEM.replace("fi", "ﬁ")
    yield "half", f"{FILL(80)} {' '.join(words[10:40])} {FILL(5)}"
    yield "word dropped", " ".join(w for i, w in enumerate(words) if i % 16 != 5)
    yield "sentences swapped", " ".join(words[30:] + words[:30])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (10, ""), (7, ITEM)], "item_id long, text string")


def found(spark, items, texts, share=Fraction(1, 3)):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, id int, item_id string")
    return {(r["doc_id"], r["item_id"]) for r in leak.leaks(df, "doc_id", "text", items, "item_id", "text", 5, share).collect()}


def test_disguises(spark, items):
    texts = list(enumerate(t for _, t in disguised()))
    assert found(spark, items, texts) == {(i, 7) for i, _ in texts}, [n for n, _ in disguised()]


def test_not_leaks(spark, items):
    words = ITEM.split()
    texts = [(1, None), (2, ""), (3, FILL(200)), (4, " ".join(words[:12])), (5, " ".join(reversed(words))), (None, ITEM), (6, " ".join(w for w in words for _ in (0, 1)))]
    assert found(spark, items, texts) == set()
    assert found(spark, items.limit(0), [(1, ITEM)]) == set()
    assert found(spark, items, []) == set()


def test_short_words_are_checked_exactly(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert found(spark, items, [(1, "x a b c d e f g h y"), (2, "ab cd ef gh"), (3, "a b c d")]) == {(1, 1)}


def test_short_and_long_words_in_one_item(spark):
    """Items without a bound leak by their short sequences or by their long ones; blocks of items don't matter."""
    items = spark.createDataFrame([(1, "a b c d e extraordinarily complicated terminology notwithstanding"), (2, "f g h i j k l")], "item_id long, text string")
    texts = [(1, "x A-b, c d e y extraordinarily"), (2, "d e extraordinarily complicated terminology, e extraordinarily complicated terminology notwithstanding"), (3, "nothing f g h i")]
    assert found(spark, items, texts) == {(2, 1)}
    assert found(spark, items, [(1, "zz f g h i j zz"), (2, "g h i j k"), (3, "fg hijk"), (4, "xf g h i j")]) == {(1, 2), (2, 2)}


def test_items_in_blocks(spark, items, monkeypatch):
    monkeypatch.setattr(leak, "ITEM_BLOCK", 800)
    more = items.union(spark.createDataFrame([(20 + i, f"{ITEM} {i} more words here now") for i in range(6)], items.schema))
    assert found(spark, more, [(1, ITEM), (2, FILL(90))]) == {(1, 7)} | {(1, 20 + i) for i in range(6)}


def test_long_text(spark, items):
    assert found(spark, items, [(1, FILL(60_000) + " " + ITEM + " " + FILL(1000))]) == {(1, 7)}


def test_against_brute_force(spark):
    texts = [" ".join(rng.choices(WORDS[:30], k=50)) for _ in range(40)]
    items = spark.createDataFrame([(i, " ".join(t.split()[5:35])) for i, t in enumerate(texts[:10])], "item_id long, text string")

    def sequences(t):
        w = ["".join(c for c in x if c.isalnum()) for x in folded(t).split()]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for d, t in enumerate(texts):
        for r in items.collect():
            s = sequences(r["text"])
            if len(s & sequences(t)) * 3 >= len(s):
                want.add((d, r["item_id"]))
    assert found(spark, items, list(enumerate(texts))) == want


def test_visible():
    assert visible("a <b>b</b>&amp;c Ã©") == "a b&c é"
    assert folded("ﬁn É а") == "fin e a"
    assert visible("3 < 5 > 2") == "3 < 5 > 2"
    for tag in ("div", "li", "table", "title", "form", "footer", "p", "br/", "/div", "DIV class='x'"):
        assert visible(f"one<{tag}>two") == "one two", tag
    for tag in ("b", "span", "sup", "a href='x'", "/EM", "wbr"):
        assert visible(f"one<{tag}>two") == "onetwo", tag
    assert visible(f"one<a title='{'x' * 4000}'>two") == "onetwo"
    assert visible(f"one<!-- {'x <b> ' * 1000}-->two<!-- never ended") == "onetwo<!-- never ended"
    assert visible("one<STYLE>p > b</Style>two<script src=x>if (a<b) c();</script>three") == "one two three"
    assert visible("p<0.05 and a<b, c>d <!DOCTYPE html><?xml version='1'?>") == "p<0.05 and a<b, c>d   "


def test_many_comments_take_linear_time():
    assert len(visible("<!--" * 200_000)) == 800_000
    assert len(visible("<a " * 200_000)) == 600_000
    assert len(visible("İ<!-- x -->" * 10_000)) == 10_000
