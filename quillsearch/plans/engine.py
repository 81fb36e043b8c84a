"""The engine as users see it: index a collection, search it, evaluate it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions.scoring import checked
from quillsearch.operators import evaluate, retrieve
from quillsearch.operators.encoded import EncodedIndex
from quillsearch.operators.index import Index
from quillsearch.operators.vector import LsiIndex
from quillsearch.sources.collection import with_paths

RETRIEVALS = ("full", "wand", "faiss")


class SearchEngine:
    """Lexical and, if built, vector index of one collection."""

    def __init__(self, index: Index | EncodedIndex | None = None, vectors: LsiIndex | None = None) -> None:
        self.index = index
        self.vectors = vectors

    @staticmethod
    def build(docs: DataFrame, mode: str = "spimi", components: int | None = None) -> SearchEngine:
        """Index ``docs (doc_id, text[, block])``; with ``components`` a vector index too."""
        return SearchEngine(Index.build(docs, mode), LsiIndex.build(docs, components) if components else None)

    def save(self, path: str, codec: str | None = None, dictionary: str = "idmap") -> None:
        """Write the indexes below ``path``; with a ``codec`` postings as encoded lists, with a stored term dictionary."""
        if self.index and codec:
            EncodedIndex.save(self.index, path, codec, dictionary)
        elif self.index:
            self.index.save(path)
        if self.vectors:
            self.vectors.save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, codec: str | None = None, dictionary: str = "idmap", vectors: str | None = None) -> SearchEngine:
        """Open what :meth:`save` wrote; the vector index may lie in a folder of its own."""
        index = EncodedIndex.load(spark, path, codec, dictionary) if codec else Index.load(spark, path)
        at = vectors or path
        return SearchEngine(index, LsiIndex.load(spark, at) if LsiIndex.has_artifacts(spark, at) else None)

    @property
    def paths(self) -> DataFrame | None:
        """The document map ``(doc_id, doc_path, doc_no)``, if the collection had paths."""
        return self.index.paths if self.index else self.vectors.paths if self.vectors else None

    def search(
        self, queries: DataFrame | str, k: int = 10, scoring: str = "bm25", retrieval: str = "full", k1: float = 1.2, b: float = 0.75, judged: DataFrame | None = None
    ) -> DataFrame:
        """``(qid, rank, doc_id, score)`` of one query text or of ``queries (qid, text)``.

        ``retrieval``: ``full`` scores every matching document, ``wand`` prunes and gives the
        same rows, ``faiss`` ranks by distance in the vector index and ignores ``scoring``. ``judged (qid, doc_id)`` leaves
        out rows that metrics don't need.
        """
        if retrieval not in RETRIEVALS:
            raise ValueError(f"retrieval is one of {RETRIEVALS}, not {retrieval!r}")
        if isinstance(queries, str):
            spark = (self.index or self.vectors).docs.sparkSession
            queries = spark.createDataFrame([("Q", queries)], "qid string, text string")
        if retrieval == "faiss":
            if self.vectors is None:
                raise ValueError("there is no vector index")
            return self.vectors.query(queries, k)
        run = retrieve.pruned_top_k if retrieval == "wand" else retrieve.top_k
        return run(self.index, queries, k, checked(scoring), k1, b, judged)

    def evaluate(self, queries: DataFrame, qrels: DataFrame, k: int = 1000, **options) -> DataFrame:
        """One row of mean metrics over all queries; zero queries are an error."""
        if not queries.select("qid").head(1):
            raise ZeroDivisionError("no queries")
        return evaluate.mean(self.evaluate_per_query(queries, qrels, k, **options))

    def evaluate_per_query(self, queries: DataFrame, qrels: DataFrame, k: int = 1000, **options) -> DataFrame:
        """Judgments name documents by their numbers, which the document map, if there is one, gives for the ids."""
        numbers = None if self.paths is None else self.paths.select(F.col("doc_no").alias("number"), F.col("doc_id").alias("id"))
        judged = qrels if numbers is None else qrels.join(numbers, F.col("doc_id") == F.col("number")).select("qid", F.col("id").alias("doc_id"))
        top = with_paths(self.search(queries, k, judged=judged, **options), self.paths)
        return evaluate.per_query(top.select("qid", "rank", F.col("doc_no").alias("doc_id")), qrels, queries.select(F.col("qid")))
