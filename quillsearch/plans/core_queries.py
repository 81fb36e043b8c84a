"""Queries of the general data-processing operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.functions.text import SPACE_RE2, clean_key
from quillsearch.operators import orphans, skew
from quillsearch.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that hold at least 2 % of the postings with a term."""
    return skew.keys_above(table(spark, sf_dir, "postings"), "term", "docno", "tf", 2).select(F.col("key").alias("term"))


def p1_term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, documents and summed tf of every term, all rows as delivered."""
    return skew.per_key_totals(table(spark, sf_dir, "postings"), "term", "docno", "tf").select(
        F.col("key").alias("term"), "n_rows", F.col("n_records").alias("n_docs"), F.col("weight_sum").alias("sum_tf")
    )


def _targets(spark: SparkSession, sf_dir: str) -> list[orphans.Target]:
    return [
        orphans.Target("collection_docs", "did", table(spark, sf_dir, "collection_docs"), "docno", "added_at", "deleted_at"),
        orphans.Target("queries", "qid", table(spark, sf_dir, "queries"), "qid", "created_at", "withdrawn_at", clean_key),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments whose file or query didn't exist when they were made."""
    refs = table(spark, sf_dir, "qrels")
    parts = [orphans.orphan_references(refs, "judgment_id", "judged_at", t) for t in _targets(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).select(F.col("ref_id").alias("judgment_id"), "ref_field").distinct()


def p4_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referenced table and month of the judgment."""
    return orphans.orphan_report(table(spark, sf_dir, "qrels"), "judgment_id", "judged_at", _targets(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_term_totals": p1_term_totals, "p4_found": p4_found, "p4_by_month": p4_by_month}

_LOST = rf"""
WITH refs AS (
  SELECT judgment_id, 'did' AS ref_field, 'collection_docs' AS ref_table, judged_at,
         NOT EXISTS (SELECT 1 FROM collection_docs d WHERE d.docno = q.did AND d.added_at <= q.judged_at
                     AND (d.deleted_at IS NULL OR q.judged_at < d.deleted_at)) AS lost
  FROM qrels q WHERE did IS NOT NULL
  UNION ALL
  SELECT judgment_id, 'qid', 'queries', judged_at,
         NOT EXISTS (SELECT 1 FROM queries d
                     WHERE upper(regexp_replace(d.qid, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')) = upper(regexp_replace(q.qid, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g'))
                     AND d.created_at <= q.judged_at AND (d.withdrawn_at IS NULL OR q.judged_at < d.withdrawn_at))
  FROM qrels q WHERE qid IS NOT NULL)
"""

ORACLES = {
    "p1_found": """
        SELECT term FROM postings WHERE term IS NOT NULL GROUP BY term
        HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM postings WHERE term IS NOT NULL)""",
    "p1_term_totals": """
        SELECT term, count(*) AS n_rows, count(DISTINCT docno) AS n_docs, CAST(coalesce(sum(tf), 0) AS BIGINT) AS sum_tf
        FROM postings WHERE term IS NOT NULL GROUP BY term""",
    "p4_found": _LOST + "SELECT DISTINCT judgment_id, ref_field FROM refs WHERE lost",
    "p4_by_month": _LOST + """
        SELECT ref_table, ref_field, month, count(*) AS n_refs, CAST(sum(lost) AS BIGINT) AS n_orphans
        FROM (SELECT judgment_id, ref_field, ref_table, strftime(judged_at, '%Y-%m') AS month, max(lost::INT) AS lost
              FROM refs GROUP BY ALL) GROUP BY ALL""",
}
