"""Mixing sources to target shares of the total size, in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsearch.session import stored

#: Vocabulary of a public byte-level tokenizer: lines of base64 token and rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents of a block of the permutation, about.
BLOCK = 4096
#: Sources a table of weights may list, else an error; it is read to the driver.
MAX_SOURCES = 100_000
#: Characters encoded at a time, about. Texts are cut only before white space, which never changes the count.
PIECE = 20_000

# fixed value: how the tokenizer splits text
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed value: what that pattern takes for white space
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUT = re.compile(f"(?!{_SPACE}).(?={_SPACE})", re.S)
#: White space of this length or more is counted apart from the pattern, which would run out of stack.
_LONG_SPACE = re.compile(_SPACE + "{50000,}")


def source_key(source: Column) -> Column:
    """A source's name in one spelling: lower case, words joined by ``_``; null for none."""
    key = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-_]+", "_")
    return F.when(key != "", key)


def pieces(text: str) -> list[str]:
    """Parts of about ``PIECE`` characters, cut between a non-space and a space; a longer run without white space stays whole."""
    out, at = [], 0
    while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def token_count(encoding, text: str) -> int:
    """Tokens of the whole text, as if it were encoded at once.

    Of white space before other characters the pattern takes all but the last character as one
    piece, at the end of a text all of it.
    """
    total, at = 0, 0
    for m in _LONG_SPACE.finditer(text):
        stop = m.end() - (m.end() < len(text))
        total += sum(len(encoding.encode_ordinary(p)) for p in pieces(text[at : m.start()]))
        total += len(encoding._encode_single_piece(text[m.start() : stop]))
        at = stop
    return total + sum(len(encoding.encode_ordinary(p)) for p in pieces(text[at:]))


def count_tokens(vocabulary: bytes):
    """mapInArrow function: ``(id, source, text)`` to ``(id, source, n_tokens)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        encoding = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [token_count(encoding, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], names=["id", "source", "n_tokens"])

    return run


def sized(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, n_tokens)`` of every document with an id and a text, once per id."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), source_key(F.col(source)).alias("source"), F.col(text).cast("string").alias("text"))
    counted = rows.where("id is not null and text is not null").mapInArrow(count_tokens(vocabulary), "id long, source string, n_tokens long")
    return counted.groupBy("id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 keeps them, 0 makes them equal."""
    raw = {k: v**exponent for k, v in shares.items() if v > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def temperature(shares: dict[str, float], target: float, repeats: dict[str, float], total: float, tokens: dict[str, int]) -> float:
    """Exponent in [0, 1] whose shares have the target entropy, or as near to it as the repetition limits allow.

    Entropy falls as the exponent rises, so it is bisected. If the shares found repeat some source
    more often than it may be, the exponent is bisected up to the least at which none is;
    at 1 a mix no larger than the sources repeats nothing.
    """

    def bisect(ok) -> float:
        lo, hi = 0.0, 1.0
        if ok(lo):
            return lo
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    def fits(e: float) -> bool:
        return all(w * total <= repeats.get(k, 1) * tokens[k] * (1 + 1e-12) for k, w in tempered(shares, e).items())

    found = bisect(lambda e: entropy(tempered(shares, e)) <= target)
    return found if fits(found) else bisect(lambda e: e >= found and fits(e))


def capped_budgets(target: dict[str, float], capacity: dict[str, int], total: float) -> dict[str, float]:
    """Budgets ``min(capacity, scale * target)`` that add up to ``total``, or to all there is.

    One scale for all sources is bisected: a source large enough keeps its target in
    proportion to every other one; a source too small gives all it may.
    """
    total = min(total, sum(capacity[k] for k, v in target.items() if v > 0))
    if total <= 0:
        return dict.fromkeys(target, 0.0)
    fill = lambda x: sum(min(capacity[k], x * v) for k, v in target.items())
    lo, hi = 0.0, max(capacity[k] / v for k, v in target.items() if v > 0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fill(mid) < total else (lo, mid)
    return {k: min(capacity[k], hi * v) for k, v in target.items()}


@dataclass(frozen=True)
class Mix:
    """``uses (id, source, n_tokens, block, uses)`` of every document in the mix, and ``shares``, the report per source."""

    uses: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, weights: DataFrame, total: float | None = None, by: str = "target", seed: int = 20) -> Mix:
    """Mix the sources of ``docs (id, source, n_tokens)`` by ``weights (source, target_share, max_repeats)``.

    ``total``: tokens wanted; by default as many as the listed sources have. ``by``: ``target``
    gives each source its target share; one too small for it is used to its repetition limit
    and the others fill up in proportion to their targets. ``temperature`` ignores single targets: natural
    shares are tempered to the entropy of the targets within the repetition limits.

    A budget is realised by block permutations: as many whole passes over the source as
    fit, then a part of one more pass in the order of a seeded permutation of its blocks
    and of the documents in a block. Whole blocks are taken by the running sum of their sizes,
    and only in the one block that the budget cuts are documents summed up one by one, so no
    source is gathered in a task. A source misses its budget by less than one document.

    Defined cases: documents without source or of a source without a weight aren't used and
    are reported with share 0; a listed source without documents reaches 0; null or
    negative shares and repeats count as 0; a source listed twice has the sum of its shares and the larger
    limit; empty documents don't take part; empty tables give no rows.
    """
    spark = docs.sparkSession
    kept = stored(docs.where("n_tokens > 0").select("id", "source", "n_tokens"), "sized")
    given = F.col("target_share").cast("double")
    listed = (
        weights.select(source_key(F.col("source")).alias("source"), F.when((given > 0) & ~F.isnan(given), given).otherwise(0.0).alias("share"), "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.max("max_repeats").alias("repeats"))
    )
    rows = listed.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    share: dict[str, float] = {r["source"]: r["share"] for r in rows}
    repeats: dict[str, int] = {r["source"]: max(0, r["repeats"] or 0) for r in rows}
    have = {
        r["source"]: (r["n"], r["t"])
        for r in kept.where("source is not null")
        .join(F.broadcast(listed.select("source")), "source", "left_semi")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
        .collect()
    }
    tokens = {k: have.get(k, (0, 0))[1] for k in share}
    capacity = {k: tokens[k] * repeats[k] for k in share}
    wanted = float(sum(tokens.values())) if total is None else float(total)
    exponent = None
    if by == "target":
        budget = capped_budgets(share, capacity, wanted)
    elif by == "temperature":
        natural = {k: v / sum(tokens.values()) for k, v in tokens.items() if v > 0 and repeats[k] > 0}
        exponent = temperature(natural, entropy(share), repeats, wanted, tokens) if natural else 1.0
        budget = capped_budgets({k: tempered(natural, exponent).get(k, 0.0) for k in share} if natural else share, capacity, wanted)
    else:
        raise ValueError("by is 'target' or 'temperature'")
    budget = {k: round(v) for k, v in budget.items()}
    plan = spark.createDataFrame(
        [
            (k, share[k], repeats[k], have.get(k, (0, 0))[0], tokens[k], budget[k], int(budget[k] // tokens[k]) if tokens[k] else 0,
             budget[k] % tokens[k] if tokens[k] else 0, max(1, -(-have.get(k, (0, 0))[0] // BLOCK)))
            for k in sorted(share)
        ],
        "source string, target_share double, max_repeats int, n_docs long, available_tokens long, budget_tokens long, passes int, rest long, n_blocks long",
    )
    rows = kept.join(F.broadcast(plan.select("source", "passes", "rest", "n_blocks")), "source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("n_blocks")))
    turn = F.xxhash64(F.lit(seed), F.lit("block"), "block")
    blocks = rows.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    whole = blocks.where(F.col("before") + F.col("t") <= F.col("rest")).select("source", "block", F.lit(1).alias("full"))
    cut = blocks.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    cut = cut.select("source", "block", (F.col("rest") - F.col("before")).alias("left"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("doc"), "id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.join(F.broadcast(cut), ["source", "block"]).withColumn("sum", F.sum("n_tokens").over(inside))
    part = part.where(F.col("sum") <= F.col("left")).select("id", F.lit(1).alias("extra"))
    uses = rows.join(whole, ["source", "block"], "left").join(part, "id", "left")
    count = F.col("passes") + F.coalesce("full", "extra", F.lit(0))
    uses = uses.select("id", "source", "n_tokens", "block", count.cast("long").alias("uses")).where("uses > 0")
    mixed = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    others = kept.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    report = plan.join(others, "source", "full").join(mixed, "source", "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("docs", F.lit(0)).alias("n_docs"),
        F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("budget_tokens", F.lit(0)).alias("budget_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.lit(exponent).cast("double").alias("exponent"),
    )
    whole_mix = mixed.agg(F.sum("mixed_tokens")).scalar()
    report = report.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.nullif(whole_mix, F.lit(0)), 9))
    return Mix(uses, report)
