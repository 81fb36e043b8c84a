"""Queries of the training-data operators. Their SQL oracles are in :mod:`.sql`."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions.text import clean_key
from quillsearch.llm import abuse, aq, leak, mix, neardup, termfreq, topn
from quillsearch.llm.sql import ORACLES  # noqa: F401
from quillsearch.session import table


def p2_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best files of every query with their ranks."""
    best = topn.top_n(table(spark, sf_dir, "evaluation"), clean_key(F.col("qid")), "did", "score", 10)
    return best.select(F.col("g").alias("qid"), F.col("item").alias("did"), "rank", "score")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best files of every query."""
    return p2_topn(spark, sf_dir).select("qid", "did")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = table(spark, sf_dir, "postings")
    counted = termfreq.term_frequencies(postings, "term", "docno", "line_no", "tf", "written_at")
    return termfreq.marks(postings, "term", "docno", counted)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms found in one file, and terms found in more than half of them."""
    return _counted(spark, sf_dir).select("term", F.explode("marks").alias("mark"))


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, lines and files of every term, with its mark if it has one."""
    return _counted(spark, sf_dir).select(
        "term", "occurrences", "n_rows", "n_docs", F.nullif(F.array_join("marks", ","), F.lit("")).alias("mark")
    )


#: Versions of each other: half of the three-word sequences in common.
_VERSIONS = neardup.Likeness(words=3, least=Fraction(1, 2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files whose texts share at least half of their three-word sequences."""
    found = neardup.near_duplicates(table(spark, sf_dir, "collection_docs"), "docno", "text", _VERSIONS)
    return neardup.document_pairs(found).select(F.col("id_a").alias("docno_a"), F.col("id_b").alias("docno_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of versions of every file, and the number of other texts it is linked to."""
    found = neardup.near_duplicates(table(spark, sf_dir, "collection_docs"), "docno", "text", _VERSIONS)
    return neardup.groups(found).select(F.col("id").alias("docno"), "group_id", "n_links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files of which one is among the 5 most similar of the other, with a cosine of at least 0.85."""
    near = aq.similar_vectors(table(spark, sf_dir, "lsi_matrix"), "docno", "vec", 128, 5, 0.85)
    return near.select(F.least("a", "b").alias("docno_a"), F.greatest("a", "b").alias("docno_b")).distinct()


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar files of every file whose docno is divisible by 100."""
    vectors = table(spark, sf_dir, "lsi_matrix")
    near = aq.search(vectors, vectors.where(F.col("docno") % 100 == 0), "docno", "vec", 128, 5)
    return near.select(F.col("a").alias("docno"), F.col("b").alias("similar"), "cos")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least a third of a test item's five-word sequences, and how many they have."""
    items = table(spark, sf_dir, "test_items")
    return leak.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text", 5, Fraction(1, 3))


def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`p7_leaks` on the runs of ``a``-``z`` and ``0``-``9`` of the lower-cased texts, which SQL can express: a check of everything but the folding."""
    plain = lambda name, key: table(spark, sf_dir, name).select(key, F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").alias("text"))
    return leak.leaks(plain("documents", "doc_id"), "doc_id", "text", plain("test_items", "item_id"), "item_id", "text", 5, Fraction(1, 3))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items and the documents that expose them."""
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id")


def _mixed(spark: SparkSession, sf_dir: str, by: str) -> mix.Mix:
    docs = mix.sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mix.mix(docs, table(spark, sf_dir, "source_weights"), by=by)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is used so that the sources reach their target shares of the tokens."""
    return _mixed(spark, sf_dir, "target").uses.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, sf_dir, "target").shares


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix has to keep, per listed source: documents used too often, and whether its tokens fall short of the budget by less than one document.

    Used from the mix itself, not from its report.
    """
    mixed = _mixed(spark, sf_dir, "target")
    limits = mixed.shares.where("source is not null").select("source", "max_repeats", "budget_tokens", "available_tokens")
    listed = table(spark, sf_dir, "source_weights").select(mix.source_key(F.col("source")).alias("source")).distinct()
    longest = mixed.uses.groupBy("source").agg(
        F.max("n_tokens").alias("longest"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most")
    )
    over = mixed.uses.join(limits, "source").where(F.col("uses") > F.col("max_repeats")).groupBy("source").agg(F.count(F.lit(1)).alias("n_over"))
    rows = listed.join(limits, "source").join(longest, "source", "left").join(over, "source", "left")
    gap = F.col("budget_tokens") - F.coalesce("tokens", F.lit(0))
    short = (gap >= 0) & (gap <= F.coalesce("longest", F.col("available_tokens")))
    return rows.select("source", F.coalesce("n_over", F.lit(0)).alias("n_over"), short.alias("within_a_document"))


def p8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the sources when their natural shares are tempered to the entropy of the targets."""
    return _mixed(spark, sf_dir, "temperature").shares


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.fit_and_score(docs, "doc_id", "text", "lang", table(spark, sf_dir, "review_labels"), "doc_id", "label")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit content."""
    return _scored(spark, sf_dir).where("flagged").select(F.col("id").alias("doc_id")).distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether it is flagged."""
    return _scored(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their share per source."""
    of = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), mix.source_key(F.col("source")).alias("source"))
    rows = _scored(spark, sf_dir).join(of, "id")
    flagged = F.sum(F.col("flagged").cast("long"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_flagged"), F.round(flagged / F.count(F.lit(1)), 6).alias("rate")
    )


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_topn, p3_found, p3_groups, p5_found, p5_search, p6_found, p6_frequencies,
        p7_found, p7_leaks, p7_words, p8_mix, p8_shares, p8_limits, p8_temperature, p9_found, p9_scores, p9_rates,
    )
}
