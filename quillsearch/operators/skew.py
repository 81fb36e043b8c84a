"""Per-key totals that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.session import parallelism

#: A key is heavy when it has more rows than this part of a fair share of a shuffle partition.
FAIR_PART = 0.25
#: Bounds of that share of all rows: keys beyond the first are heavy in any case, and at most 1 / LEAST_SHARE keys can be heavy.
MOST_SHARE, LEAST_SHARE = 0.005, 1 / 4096
#: Counters of the frequent-items sketch. Its error is about 3.5 / SKETCH_ITEMS of the rows, below LEAST_SHARE.
SKETCH_ITEMS = 16_384


@dataclass(frozen=True)
class HeavyKeys:
    """Heavy keys (a DataFrame of at most ``2 / share`` rows) and the number of rows with a key."""

    keys: DataFrame
    total: int


def heavy_share(spark: SparkSession) -> float:
    """Share of the rows from which a key counts as heavy: ``FAIR_PART`` of a shuffle partition, within the stated bounds."""
    return min(MOST_SHARE, max(LEAST_SHARE, FAIR_PART / parallelism(spark)))


def heavy_keys(df: DataFrame, key: str, share: float | None = None, items: int = SKETCH_ITEMS) -> HeavyKeys:
    """Find heavy keys with one mergeable frequent-items sketch over the key column.

    The sketch is a partial aggregate, so the shuffle carries one sketch per task. It
    decides only which way a key takes; totals are exact either way. What reaches the
    driver and is broadcast later is at most ``2 / share`` keys, whatever the input size.
    """
    spark = df.sparkSession
    share = share or heavy_share(spark)
    most = min(items, int(2 / share))
    column = F.col(key)
    row = (
        df.select(column.alias("k"))
        .where(F.col("k").isNotNull())
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {items})").alias("top"))
        .head()
    )
    total = row["n"] or 0
    found = [(x["item"],) for x in row["top"] or [] if x["count"] >= share * total]
    schema = df.select(column.alias("k")).schema
    return HeavyKeys(spark.createDataFrame(found, schema), total)


def per_key_totals(
    df: DataFrame, key: str, record: str, weight: str, share: float | None = None, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Rows, distinct records and summed weight of every key: ``(key, n_rows, n_records, weight_sum)``.

    Heavy keys are split off by a broadcast join and cut into parts by a hash of the record,
    one for every shuffle partition; what then meets per key is one row a part. The other
    keys take the ordinary shuffle. Both are aggregated by ``(key, record)`` before they are
    shuffled, so no key of any share sends its raw rows to one task. The results are unioned.

    Defined cases: rows with a null key are left out; a null record counts as a row but
    not as a record; a null weight adds nothing, a key with only null weights has
    ``weight_sum`` 0. Repeated rows count as often as they occur. An empty table gives
    no rows. Only the three named columns are read, so other columns, whatever their
    names, don't matter.
    """
    heavy = heavy or heavy_keys(df, key, share)
    rows = df.select(F.col(key).alias("k"), F.col(record).alias("r"), F.col(weight).alias("w")).where(
        F.col("k").isNotNull()
    )
    keys = F.broadcast(heavy.keys)
    pair = (F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    whole = (
        F.sum("n").alias("n_rows"),
        F.count("r").alias("n_records"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("weight_sum"),
    )
    few = rows.join(keys, "k", "left_semi").groupBy("k", "r").agg(*pair)
    few = few.groupBy("k", F.pmod(F.xxhash64("r"), F.lit(parallelism(df.sparkSession))).alias("part")).agg(*whole)
    few = few.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_records", "weight_sum")))
    rest = rows.join(keys, "k", "left_anti").groupBy("k", "r").agg(*pair).groupBy("k").agg(*whole)
    return few.unionByName(rest).withColumnRenamed("k", "key")


def keys_above(df: DataFrame, key: str, record: str, weight: str, percent: int) -> DataFrame:
    """Keys whose rows are at least ``percent`` % of all rows with a key, with their totals.

    Compared in whole numbers, so a key exactly at the bound is in.
    """
    heavy = heavy_keys(df, key)
    totals = per_key_totals(df, key, record, weight, heavy=heavy)
    return totals.where(F.col("n_rows") * 100 >= F.lit(percent * heavy.total))
