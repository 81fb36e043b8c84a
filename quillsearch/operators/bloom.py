"""Bloom filters of key columns, built by the executors and probed in generated code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column, _to_seq

from quillsearch.session import stored

#: A filter has at most this many bits (8 MB). Keys beyond what that holds are spread by their hash over several filters, at
#: most ``MAX_FILTERS``; beyond those the filters only let more keys through to the exact step.
MAX_FILTER_BITS = 67_108_864
BITS_PER_KEY = 12
MAX_FILTERS = 16


def _object(spark: SparkSession, name: str):
    return getattr(getattr(spark._jvm, name + "$"), "MODULE$")


@dataclass(frozen=True)
class Bloom:
    """Filters as scalar subqueries; a key belongs to the one its hash names."""

    parts: list[Column]


def _which(hash_: Column, n: int) -> Column:
    """Filter of a hashed key, from other bits than those the filters use first."""
    return F.pmod(F.xxhash64(hash_), F.lit(n))


def filter_of(keys: DataFrame, key: str, most: int | None = None) -> Bloom:
    """Bloom filters of a column, at most ``most``, sized from the number of rows. Nulls aren't in them; an empty table's filter is null."""
    spark = keys.sparkSession
    n = max(1, keys.count())
    filters = min(most or MAX_FILTERS, -(-n * BITS_PER_KEY // MAX_FILTER_BITS))
    items = max(1, min(-(-n // filters), MAX_FILTER_BITS // BITS_PER_KEY))
    bits = min(MAX_FILTER_BITS, max(1024, items * BITS_PER_KEY))
    rows = keys.select(F.col(key).alias("k")).where("k is not null").select(F.xxhash64("k").alias("h"))
    args = [F.col("h"), F.lit(items).cast("long"), F.lit(bits).cast("long")]
    parts = []
    for i in range(filters):
        own = rows if filters == 1 else rows.where(_which(F.col("h"), filters) == i)
        made = _object(spark, "org.apache.spark.sql.Column").internalFn(
            "bloom_filter_agg", _to_seq(spark.sparkContext, args, _to_java_column)
        )
        parts.append(own.select(ClassicColumn(made).alias("b")).scalar())
    return Bloom(parts)


def might_contain(bloom: Bloom, key: Column) -> Column:
    """False proves that ``key`` isn't among the filters' keys."""
    spark = SparkSession.active()
    utils = _object(spark, "org.apache.spark.sql.classic.ExpressionUtils")
    hash_ = F.xxhash64(key)

    def probe(part: Column) -> Column:
        made = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
            utils.expression(part._jc), utils.expression(hash_._jc)
        )
        return F.coalesce(ClassicColumn(utils.column(made)), F.lit(False))

    if len(bloom.parts) == 1:
        return probe(bloom.parts[0])
    which, out = _which(hash_, len(bloom.parts)), F.lit(False)
    for i, part in enumerate(bloom.parts):
        out = F.when(which == i, probe(part)).otherwise(out)
    return out


def in_passes(keys: DataFrame, key: str, of: str, name: str, run: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """Union of ``run(keys, screened)`` over parts of the keys by their hash, one after the other; ``screened(rows)`` are the rows whose ``of`` may be a key of the part.

    A filter passes through the driver and the plan of every stage that probes it, so each part has a single filter,
    however many keys there are. The results of several parts are written to the shared folder; one part stays a lazy plan.
    """
    n = keys.count()
    # hashes don't part the keys quite evenly
    parts = max(1, -(-n * (BITS_PER_KEY + 1) // MAX_FILTER_BITS))
    out = None
    for i in range(parts):
        within = lambda rows, column, i=i: rows if parts == 1 else rows.where(_which(F.xxhash64(column), parts) == i)
        own = within(keys, key)
        bloom = filter_of(own, key, 1)
        screened = lambda rows, within=within, bloom=bloom: within(rows, of).where(might_contain(bloom, F.col(of)))
        got = run(own, screened)
        got = got if parts == 1 else stored(got, name)
        out = got if out is None else out.unionByName(got)
    return out
