"""Index on disk: encoded posting lists, a stored term dictionary and a document map, searched without unpacking it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions import codecs
from quillsearch.operators.dictionary import IdMap, RadixTree, dense_ids
from quillsearch.operators.index import Index, corpus_stats, encoded
from quillsearch.session import discard, has_table, parallelism, stored

#: Term dictionaries an index can have.
DICTIONARIES = {"idmap": IdMap, "patricia": RadixTree}


def dictionary_named(name: str) -> type[IdMap] | type[RadixTree]:
    if name not in DICTIONARIES:
        raise ValueError(f"the term dictionary is one of {tuple(DICTIONARIES)}, not {name!r}")
    return DICTIONARIES[name]


@dataclass(frozen=True)
class EncodedIndex:
    """Answers what :class:`~quillsearch.operators.index.Index` answers, from encoded lists.

    ``lists (term_id, segment, df, ids, tfs)`` are ordered by term id, ``stats (term_id, df, max_tf, cf)``
    holds one row per term. Only lists of asked terms are read and decoded.
    """

    lists: DataFrame
    stats: DataFrame
    dictionary: IdMap | RadixTree
    codec: str
    docs: DataFrame
    n_docs: int
    avg_dl: float
    min_dl: int
    paths: DataFrame | None = None

    @staticmethod
    def save(index: Index, path: str, codec: str = "vbe", dictionary: str = "idmap") -> None:
        """Write the index below ``path``; indexes of other codecs and dictionaries may lie beside it."""
        kind = dictionary_named(dictionary)
        ids = stored(dense_ids(index.terms), "term-ids")
        kind.build(index.terms, ids).save(f"{path}/dictionary-{dictionary}")
        index.terms.join(ids, "term").select("term_id", "df", "max_tf", "cf").write.mode("overwrite").parquet(f"{path}/term-stats")
        # stored, else the bounds of the ranges would take the encoding of all lists once more
        lists = stored(encoded(index.postings, codec).join(ids, "term").select("term_id", "segment", "df", "ids", "tfs"), "lists")
        ordered = lists.repartitionByRange(parallelism(lists.sparkSession), "term_id", "segment").sortWithinPartitions("term_id", "segment")
        ordered.write.mode("overwrite").parquet(f"{path}/lists-{codec}")
        discard(lists)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs")
        corpus_stats(index.docs).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        if index.paths is not None:
            index.paths.write.mode("overwrite").parquet(f"{path}/paths")

    @staticmethod
    def load(spark: SparkSession, path: str, codec: str = "vbe", dictionary: str = "idmap") -> EncodedIndex:
        kind = dictionary_named(dictionary)
        if codec not in codecs.CODECS:
            raise ValueError(f"codec is one of {codecs.CODECS}, not {codec!r}")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        n, avg, least = read("corpus").head()
        paths = read("paths") if has_table(spark, f"{path}/paths") else None
        made = kind.load(spark, f"{path}/dictionary-{dictionary}")
        return EncodedIndex(read(f"lists-{codec}"), read("term-stats"), made, codec, read("docs"), n, float(avg), least, paths)

    @property
    def terms(self) -> DataFrame:
        """``(term, df, max_tf, cf)`` of all terms."""
        return self.stats.join(self.dictionary.all(), "term_id").select("term", "df", "max_tf", "cf")

    def known(self, words: DataFrame) -> DataFrame:
        """``words`` with the ids and statistics of those that the index has."""
        ids = stored(self.dictionary.ids_of(words.select("term")).where("term_id >= 0"), "asked-ids")
        return words.join(ids.join(self.stats, "term_id").select("term", "term_id", "df", "max_tf"), "term")

    def _decoded(self, lists: DataFrame) -> DataFrame:
        both = F.arrays_zip(
            codecs.decode_ids(self.codec, F.col("ids")).alias("doc_id"), codecs.decode_counts(self.codec, F.col("tfs")).alias("tf")
        )
        return lists.select("term", F.explode(both).alias("p")).select("term", F.col("p.doc_id").alias("doc_id"), F.col("p.tf").alias("tf"))

    def hits(self, words: DataFrame) -> DataFrame:
        """``(term, doc_id, tf, dl)`` of the terms in ``words (term)``, few enough to be broadcast, none twice; with their ``term_id`` they aren't looked up again."""
        if "term_id" in words.columns:
            ids = words.select("term", F.col("term_id").cast("long").alias("term_id"))
        else:
            ids = stored(self.dictionary.ids_of(words.select("term")).where("term_id >= 0"), "asked-ids")
        asked = self.lists.join(F.broadcast(ids), "term_id")
        return self._decoded(asked).join(self.docs, "doc_id").select("term", "doc_id", "tf", "dl")

    def scan(self) -> DataFrame:
        """``(term, doc_id, tf)`` of all lists, term by term in the stored order inside each partition."""
        return self._decoded(self.lists.join(self.dictionary.all(), "term_id"))
