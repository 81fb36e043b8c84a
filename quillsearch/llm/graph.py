"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsearch.session import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation. Minima are partial aggregates and rows of a hot node stay rows, so a node of any degree spreads."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        moved = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", "b"))).head())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge ``(a, b)``; the component is its least node.

    Ends when a round changes nothing, which for n nodes takes about log n rounds. Links
    never leave the executors: between rounds they are written to the shared folder.
    Loops and repeated edges don't matter; without edges the result is empty.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(ordered, "edges")
    before = _state(now)
    while True:
        nxt = stored(_stars(_stars(now, large=True), large=False), "edges")
        after = _state(nxt)
        discard(now)
        now = nxt
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
