"""References to rows that do not exist, or did not exist at the time of the reference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsearch.operators.bloom import filter_of, might_contain


@dataclass(frozen=True)
class Target:
    """A referenced table: ``field`` of the referring table holds ``key`` of ``rows``, alive from ``start`` to ``end``."""

    name: str
    field: str
    rows: DataFrame
    key: str
    start: str
    end: str
    normal: Callable[[Column], Column] = lambda c: c


def alive_spans(target: Target) -> DataFrame:
    """Disjoint spans ``(k, since, until)`` in which a key existed; ``until`` null: open.

    Repeated deliveries and overlapping lives of one key merge, so a key that was
    delivered a million times costs one span. Rows with a null key or start are never alive.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    rows = target.rows.select(
        target.normal(F.col(target.key)).alias("k"),
        F.col(target.start).cast("timestamp_ntz").alias("since"),
        F.coalesce(F.col(target.end).cast("timestamp_ntz"), far).alias("until"),
    ).where("k is not null and since is not null and since < until")
    # one row per (key, start) before the shuffle by key
    rows = rows.groupBy("k", "since").agg(F.max("until").alias("until"))
    order = Window.partitionBy("k").orderBy("since")
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (before.isNull() | (before < F.col("since"))).cast("int"))
    rows = rows.withColumn("span", F.sum("fresh").over(order))
    spans = rows.groupBy("k", "span").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    return spans.select("k", "since", F.nullif("until", far).alias("until"))


def orphan_references(refs: DataFrame, ref_id: str, at: str, target: Target) -> DataFrame:
    """References of ``refs`` to ``target`` that had no living target row: ``(ref_id, ref_field, at)``.

    1. Bloom filters of the target's keys, 8 MB each and sized from the number of its rows,
       prove that a key never existed; such references are orphans without a join.
    2. Only references that pass the filter are joined exactly, by key and time.

    Defined cases: a null reference is no case; a null ``at`` has no living target; a
    reference delivered twice is one case; with an empty target table every reference is
    an orphan. Rows of one hot key stay on the streamed side of an anti join, which AQE
    can split; the other side holds one row per life span.
    """
    base = refs.select(
        F.col(ref_id).alias("ref_id"),
        target.normal(F.col(target.field)).alias("k"),
        F.col(at).cast("timestamp_ntz").alias("at"),
    ).where("k is not null")
    keys = target.rows.select(target.normal(F.col(target.key)).alias("k"))
    base = base.withColumn("maybe", might_contain(filter_of(keys, "k"), F.col("k")))
    proven = base.where(~F.col("maybe"))
    spans = alive_spans(target).alias("s")
    open_ = base.where("maybe").alias("b")
    lost = open_.join(
        spans,
        (F.col("b.k") == F.col("s.k"))
        & (F.col("s.since") <= F.col("b.at"))
        & (F.col("s.until").isNull() | (F.col("b.at") < F.col("s.until"))),
        "left_anti",
    )
    both = proven.select("ref_id", "at").unionByName(lost.select("ref_id", "at"))
    return both.distinct().select("ref_id", F.lit(target.field).alias("ref_field"), "at")


def orphan_report(refs: DataFrame, ref_id: str, at: str, targets: list[Target]) -> DataFrame:
    """References, orphans and their share per referenced table and month: ``(ref_table, ref_field, month, n_refs, n_orphans)``.

    A month without orphans is listed with 0. References whose time is null have a null month.
    """
    parts = []
    for t in targets:
        month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
        lost = orphan_references(refs, ref_id, at, t).select("ref_id", month).withColumn("lost", F.lit(1))
        every = (
            refs.select(F.col(ref_id).alias("ref_id"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(t.field).alias("k"))
            .where("k is not null")
            .select("ref_id", month)
            .withColumn("lost", F.lit(0))
        )
        cases = every.unionByName(lost).groupBy("ref_id", "month").agg(F.max("lost").alias("lost"))
        parts.append(
            cases.groupBy("month")
            .agg(F.count(F.lit(1)).alias("n_refs"), F.sum("lost").alias("n_orphans"))
            .select(F.lit(t.name).alias("ref_table"), F.lit(t.field).alias("ref_field"), "month", "n_refs", "n_orphans")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
