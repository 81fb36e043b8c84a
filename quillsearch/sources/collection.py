"""Text collections, query files and relevance judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions.text import words_by_space
from quillsearch.operators.dictionary import dense_ids

#: The demonstration queries (fixed values).
DEMO_QUERIES = (
    "alkylated with radioactive iodoacetate",
    "psychodrama for disturbed children",
    "lipid metabolism in toxemia and normal pregnancy",
)


#: Judgments that a copy of the judgment file is known by (fixed values): query, document, relevance.
KNOWN_JUDGMENTS = (("Q1", 166, 1), ("Q1", 300, 0))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(block, doc_path, doc_no, doc_id, text)`` of a folder whose sub-folders are blocks of text files, one file a document.

    ``doc_path`` begins with the folder as it was given; ``doc_id`` numbers the paths from 0 in
    sorted order, whatever their names; ``doc_no`` is the number that is the file's name, null for
    other names. Files directly in the folder or deeper than one level aren't read.
    """
    files = spark.read.text(f"{path.rstrip('/')}/*/*", wholetext=True).select("value", plain_path(F.col("_metadata.file_path"), path).alias("doc_path"))
    ids = dense_ids(files.select(F.col("doc_path").alias("term"))).toDF("doc_path", "doc_id")
    return files.join(ids, "doc_path").select(
        F.element_at(F.split("doc_path", "/"), -2).alias("block"),
        "doc_path",
        external_id(F.col("doc_path")).alias("doc_no"),
        "doc_id",
        F.col("value").alias("text"),
    )


def plain_path(uri: Column, folder: str) -> Column:
    """``folder/block/file`` of a file's address, with its special characters as they are."""
    ends = F.slice(F.split(uri, "/"), -2, 2)
    decoded = F.transform(ends, lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.array_join(decoded, "/"))


def external_id(path: Column) -> Column:
    """Number in a file name: ``.../17.txt`` gives 17, other names null."""
    return F.nullif(F.regexp_extract(path, r"/([0-9]+)(\.[^./]*)?$", 1), F.lit("")).cast("long")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)`` of lines ``QID word word ...``; blank lines are skipped."""
    parts = spark.read.text(path).select(words_by_space(F.col("value")).alias("w")).where("size(w) > 0")
    return parts.select(F.element_at("w", 1).alias("qid"), F.array_join(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), " ").alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id)`` of relevant pairs from lines ``QID DOCID``; every other pair is irrelevant. Blank lines are skipped."""
    parts = spark.read.text(path).select(words_by_space(F.col("value")).alias("w")).where("size(w) >= 2")
    return parts.select(F.element_at("w", 1).alias("qid"), F.element_at("w", 2).cast("long").alias("doc_id")).distinct()


def dense_qrels(qrels: DataFrame, queries: int = 30, docs: int = 1033) -> DataFrame:
    """``(qid, doc_id, rel)`` for all of Q1.. and 1.., 0 where nothing is judged: a table of a stated size."""
    spark = qrels.sparkSession
    grid = spark.range(1, queries + 1).select(F.concat(F.lit("Q"), F.col("id")).alias("qid"))
    grid = grid.withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(docs)))).withColumn("doc_id", F.col("doc_id").cast("long"))
    judged = qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    return grid.join(judged, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("rel", F.lit(0)).alias("rel"))


def demo_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"D{i + 1}", q) for i, q in enumerate(DEMO_QUERIES)], "qid string, text string")


def check_judgments(qrels: DataFrame, known: tuple[tuple[str, int, int], ...] = KNOWN_JUDGMENTS) -> None:
    """ValueError unless ``qrels (qid, doc_id)`` has every known judgment."""
    pairs = {(q, d) for q, d, _ in known}
    some = qrels.where(F.col("qid").isin([q for q, _ in pairs]) & F.col("doc_id").isin([d for _, d in pairs]))
    found = {(r["qid"], r["doc_id"]) for r in some.select("qid", "doc_id").distinct().collect()}
    for q, d, rel in known:
        if ((q, d) in found) != bool(rel):
            raise ValueError(f"the judgments aren't the expected ones: {q} {d} should be {rel}")


def with_paths(ranking: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``ranking`` with ``doc_path`` and ``doc_no``; without a document map the id stands for both."""
    if paths is None:
        return ranking.withColumn("doc_path", F.col("doc_id").cast("string")).withColumn("doc_no", F.col("doc_id"))
    return ranking.join(paths, "doc_id", "left")


def result_lines(ranking: DataFrame, name: str = "doc_path") -> DataFrame:
    """Printable lines: the document in at least 30 columns and the score with 3 decimals, rounded half up from its 6."""
    shown = F.col(name).cast("string")
    padded = F.when(F.length(shown) < 30, F.rpad(shown, 30, " ")).otherwise(shown)
    return ranking.select("qid", "rank", F.concat(padded, F.lit(" "), F.format_string("%.3f", F.col("score"))).alias("line"))
