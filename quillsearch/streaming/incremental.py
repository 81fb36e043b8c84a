"""Index maintenance as new blocks of a collection arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsearch.operators.index import Index, document_map, merge_postings, postings_of
from quillsearch.session import stored
from quillsearch.sources.collection import external_id, plain_path


def read_blocks(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Stream ``(doc_id, doc_path, text)`` of a folder of blocks of text files, as they appear.

    Ids can't follow the order of all paths here: ``doc_id`` is the number that is the file's name,
    for other names a hash of the path below 0.
    """
    files = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(f"{path.rstrip('/')}/*/*")
        .select("value", plain_path(F.col("_metadata.file_path"), path).alias("doc_path"))
    )
    other = -1 - F.xxhash64("doc_path").bitwiseAND(F.lit(2**62 - 1))
    return files.select(F.coalesce(external_id(F.col("doc_path")), other).alias("doc_id"), "doc_path", F.col("value").alias("text"))


def append_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's postings below ``path`` by its number, so a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        document_map(batch).write.mode("overwrite").parquet(f"{path}/paths/batch={number}")
        postings_of(batch).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """``(term, doc_id, tf)`` of all batches so far; frequencies of the same term and document add up."""
    return merge_postings(spark.read.parquet(f"{path}/postings"))


def index_so_far(spark: SparkSession, path: str) -> Index:
    """Index of all batches so far, with term, document and corpus statistics and the document map."""
    return Index.of_postings(stored(merged(spark, path), "merged"), spark.read.parquet(f"{path}/paths").drop("batch").distinct())
