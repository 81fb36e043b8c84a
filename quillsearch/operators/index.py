"""Inverted index as DataFrames: postings and the statistics derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsearch.functions import codecs
from quillsearch.functions.text import words_by_space
from quillsearch.session import has_table, parallelism, stored

#: Index modes: one group-by over all documents, or one per block and a merge. The postings are the same.
INDEX_MODES = ("spimi", "bsbi")
#: Document ids are cut into ranges of 2 to this power. A term's postings of one range are one
#: encoded list, so no list is unbounded; collections with smaller ids have one list a term.
RANGE_BITS = 20


def occurrences(docs: DataFrame, tokens: Callable[[Column], Column] = words_by_space) -> DataFrame:
    """``(doc_id, term)``, one row per token of ``docs (doc_id, text)``. Null ids and texts give none."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))


def postings_of(docs: DataFrame, tokens: Callable[[Column], Column] = words_by_space) -> DataFrame:
    """``(term, doc_id, tf)``. Counting is a partial aggregate, so only counts are shuffled."""
    return occurrences(docs, tokens).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Union of postings of several blocks; frequencies of the same term and document add up."""
    whole = parts[0].select("term", "doc_id", "tf")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("term", "doc_id", "tf"))
    return whole.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def block_postings(docs: DataFrame) -> DataFrame:
    """``(block, term, doc_id, tf)`` of ``docs (block, doc_id, text)``: the postings of every block by itself."""
    rows = docs.where("doc_id is not null and text is not null")
    words = rows.select("block", "doc_id", F.explode(words_by_space(F.col("text"))).alias("term"))
    return words.groupBy("block", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(postings: DataFrame) -> DataFrame:
    """``(doc_id, dl)``: tokens of every document that has any."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df, max_tf, cf)``: documents, largest count in a document, occurrences."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.sum("tf").alias("cf")
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row ``(n_docs, avg_dl, min_dl)`` of document statistics; 0 for an empty collection."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"),
        F.coalesce(F.min("dl"), F.lit(0)).alias("min_dl"),
    )


def document_map(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_path, doc_no)`` of documents with an id and a path."""
    number = F.col("doc_no").cast("long") if "doc_no" in docs.columns else F.col("doc_id").cast("long")
    return docs.where("doc_id is not null and doc_path is not null").select("doc_id", "doc_path", number.alias("doc_no")).distinct()


@dataclass(frozen=True)
class Index:
    """Postings with document lengths, and term, document and corpus statistics.

    ``n_docs``, ``avg_dl`` and ``min_dl`` are plain numbers, so they fold into the plans.
    """

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    n_docs: int
    avg_dl: float
    min_dl: int
    paths: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, mode: str = "spimi") -> Index:
        """Index ``docs (doc_id, text)`` (``bsbi`` needs ``block`` as well) and store it in the shared folder.

        With ``doc_path`` (and ``doc_no``, the document's number outside the index) the document map is kept as ``paths``.
        """
        if mode not in INDEX_MODES:
            raise ValueError(f"index mode is one of {INDEX_MODES}, not {mode!r}")
        spark = docs.sparkSession
        # few large input files would leave most cores idle
        spread = docs.repartition(parallelism(spark))
        raw = postings_of(spread) if mode == "spimi" else merge_postings(block_postings(spread))
        paths = stored(document_map(docs), "paths") if "doc_path" in docs.columns else None
        return Index.of_postings(stored(raw, "raw-postings"), paths)

    @staticmethod
    def of_postings(raw: DataFrame, paths: DataFrame | None = None) -> Index:
        """Index of stored postings ``(term, doc_id, tf)``."""
        spark = raw.sparkSession
        docs = stored(doc_stats(raw), "docs")
        sorted_ = raw.join(docs, "doc_id").repartitionByRange(parallelism(spark), "term", "doc_id")
        postings = stored(sorted_.sortWithinPartitions("term", "doc_id").select("term", "doc_id", "tf", "dl"), "postings")
        terms = stored(term_stats(postings), "terms")
        n, avg, least = corpus_stats(docs).head()
        return Index(postings, terms, docs, n, float(avg), least, paths)

    def save(self, path: str) -> None:
        """Write the tables as Parquet below ``path``; postings keep their order by term, which lets readers skip row groups."""
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        corpus_stats(self.docs).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        if self.paths is not None:
            self.paths.write.mode("overwrite").parquet(f"{path}/paths")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        n, avg, least = read("corpus").head()
        paths = read("paths") if has_table(spark, f"{path}/paths") else None
        return Index(read("postings"), read("terms"), read("docs"), n, float(avg), least, paths)

    def known(self, words: DataFrame) -> DataFrame:
        """``words`` with the statistics of those that the index has."""
        return words.join(self.terms.select("term", "df", "max_tf"), "term")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms in ``terms (term)``; unknown terms give none."""
        return self.postings.join(terms.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "tf")

    def hits(self, words: DataFrame) -> DataFrame:
        """``(term, doc_id, tf, dl)`` of the terms in ``words (term)``, few enough to be broadcast, none twice."""
        return self.postings.join(F.broadcast(words), "term", "left_semi")

    def postings_of_term(self, term: str) -> DataFrame:
        """Postings of one term; the filter reaches the scan."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf")


def posting_lists(postings: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(term, segment, ids, tfs)``: parallel lists by ascending id, one per range of ids."""
    rows = postings.withColumn("segment", F.shiftright("doc_id", range_bits))
    lists = rows.groupBy("term", "segment").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("list"))
    return lists.select("term", "segment", F.col("list.doc_id").alias("ids"), F.col("list.tf").alias("tfs"))


def encoded(postings: DataFrame, codec: str, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(term, segment, codec, df, ids, tfs)`` with ids and frequencies as bytes."""
    return posting_lists(postings, range_bits).select(
        "term",
        "segment",
        F.lit(codec).alias("codec"),
        F.size("ids").alias("df"),
        codecs.encode_ids(codec, F.col("ids")).alias("ids"),
        codecs.encode_counts(codec, F.col("tfs")).alias("tfs"),
    )


def decoded(lists: DataFrame, codec: str) -> DataFrame:
    """``(term, doc_id, tf)`` from :func:`encoded` lists."""
    both = F.arrays_zip(codecs.decode_ids(codec, F.col("ids")).alias("doc_id"), codecs.decode_counts(codec, F.col("tfs")).alias("tf"))
    return lists.select("term", F.explode(both).alias("p")).select("term", F.col("p.doc_id").alias("doc_id"), F.col("p.tf").alias("tf"))


def gap_rows(postings: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """``(term, doc_id, tf, gap)``: distance to the term's document before, the id itself for the first.

    Neighbours are found inside ranges of ids, so a term of a third of all postings is many
    windows; the ends of the ranges are joined from a table of one row per term and range.
    """
    rows = postings.select("term", "doc_id", "tf", F.shiftright("doc_id", range_bits).alias("segment"))
    ends = rows.groupBy("term", "segment").agg(F.max("doc_id").alias("last"))
    before = F.lag("last").over(Window.partitionBy("term").orderBy("segment"))
    ends = ends.select("term", "segment", before.alias("before")).where("before is not null")
    inside = F.lag("doc_id").over(Window.partitionBy("term", "segment").orderBy("doc_id"))
    rows = rows.withColumn("inside", inside).join(ends, ["term", "segment"], "left")
    return rows.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("inside", "before", F.lit(0))).alias("gap"))


def codec_sizes(postings: DataFrame) -> DataFrame:
    """``(term, std_bytes, vbe_bytes, eg_bytes)`` of every term's two lists, in closed form, without encoding them."""
    bits = lambda c: F.lit(2) * codecs.bit_length(c) - 1
    return gap_rows(postings).groupBy("term").agg(
        (F.count(F.lit(1)) * 16).alias("std_bytes"),
        (F.sum(codecs.vbe_bytes(F.col("gap"))) + F.sum(codecs.vbe_bytes(F.col("tf")))).alias("vbe_bytes"),
        (8 + F.ceil(F.sum(bits(F.col("gap") + 1)) / 8) + F.ceil(F.sum(bits(F.col("tf"))) / 8)).cast("long").alias("eg_bytes"),
    )
