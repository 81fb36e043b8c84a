"""Ranking metrics of many queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relevance(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid, rank, doc_id, rel)``: 1 for judged pairs of ``qrels (qid, doc_id)``, else 0."""
    judged = qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    return ranking.join(judged, ["qid", "doc_id"], "left").select("qid", "rank", "doc_id", F.coalesce("rel", F.lit(0)).alias("rel"))


def metrics(rels: DataFrame, p: float = 0.8, cut: int = 10, strict: bool = False) -> DataFrame:
    """``(qid, rbp, dcg, ndcg, ap)`` of ``rels (qid, rank, rel)``; rows that aren't relevant may be missing, but for the last of a query.

    RBP leaves out the last rank unless ``strict``. DCG and NDCG take the first ``cut`` ranks, AP
    all. NDCG and AP are normalised by the relevant documents that were retrieved.
    """
    by = Window.partitionBy("qid")
    rows = rels.withColumn("n", F.max("rank").over(by))
    rows = rows.withColumn("hits", F.sum("rel").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("ideal", F.row_number().over(by.orderBy(F.desc("rel"), "rank")))
    rel, rank = F.col("rel").cast("double"), F.col("rank").cast("double")
    counted = F.lit(True) if strict else F.col("rank") < F.col("n")
    gain = lambda at: rel / F.log2(at.cast("double") + 1)
    zero = F.lit(0.0)
    out = rows.groupBy("qid").agg(
        (F.sum(F.when(counted, rel * F.pow(F.lit(float(p)), rank - 1)).otherwise(zero)) * F.lit(1.0 - p)).alias("rbp"),
        F.sum(F.when(F.col("rank") <= cut, gain(F.col("rank"))).otherwise(zero)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= cut, gain(F.col("ideal"))).otherwise(zero)).alias("idcg"),
        F.sum(F.when(F.col("rel") > 0, F.col("hits") / rank).otherwise(zero)).alias("precision"),
        F.sum(rel).alias("found"),
    )
    return out.select(
        "qid",
        "rbp",
        "dcg",
        F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), zero), zero).alias("ndcg"),
        F.coalesce(F.col("precision") / F.nullif(F.col("found"), zero), zero).alias("ap"),
    )


def per_query(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, decimals: int = 6, **options) -> DataFrame:
    """Metrics of every query; a query without results counts with 0."""
    got = metrics(relevance(ranking, qrels), **options)
    names = ("rbp", "dcg", "ndcg", "ap")
    return queries.select("qid").distinct().join(got, "qid", "left").select(
        "qid", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), decimals).alias(c) for c in names]
    )


def mean(per: DataFrame, decimals: int = 5) -> DataFrame:
    """``(n_queries, rbp, dcg, ndcg, ap)``: unweighted means, and the true number of queries."""
    return per.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), decimals).alias(c) for c in ("rbp", "dcg", "ndcg", "ap")])
