"""How often every term occurs, and in how many records, by external sort and run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsearch.session import parallelism

_SCHEMA = "term string, occurrences long, n_rows long, n_docs long"


def _differs(c: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value isn't that of the row before; ``before`` is the last value of the batch before."""
    out = np.ones(len(c), bool)
    # nulls only meet in the part column; a null equals a null there
    same = pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
    out[1:] = ~same.to_numpy(zero_copy_only=False)
    if before is not None:
        out[0] = before.as_py() != c[0].as_py()
    return out


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of rows sorted by (term, record, part, version descending).

    Each batch gives one partial row per term in it. It holds one batch and the last row
    of the one before. Of the rows of one (term, record, part) only the first counts.
    """
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        term, record, part = b.column("term"), b.column("record"), b.column("part")
        p = last or (None, None, None)
        t = _differs(term, p[0])
        r = t | _differs(record, p[1])
        u = r | _differs(part, p[2])
        weight = b.column("weight").to_numpy(zero_copy_only=False)
        has = record.is_valid().to_numpy(zero_copy_only=False)
        begin = t.copy()
        begin[0] = True
        at = np.flatnonzero(begin)
        yield pa.RecordBatch.from_arrays(
            [
                term.take(pa.array(at)),
                pa.array(np.add.reduceat(np.where(u, weight, 0), at), pa.int64()),
                pa.array(np.add.reduceat(u.astype(np.int64), at), pa.int64()),
                pa.array(np.add.reduceat((r & has).astype(np.int64), at), pa.int64()),
            ],
            names=["term", "occurrences", "n_rows", "n_docs"],
        )
        last = (term[-1], record[-1], part[-1])


def term_frequencies(df: DataFrame, term: str, record: str, part: str, weight: str, version: str) -> DataFrame:
    """Occurrences, places and records of every term: ``(term, occurrences, n_rows, n_docs)``.

    Rows are range-partitioned by (term, record) and sorted inside the partitions, with spill.
    Ranges cut through a frequent term, so no task has to take one as a whole, while the
    rows of one (term, record) stay together, so distinct records add up over ranges.
    A scan of run lengths counts them; the last aggregate merges a few partial rows a term.

    Defined cases: a null term isn't counted; a null record counts as a place but not
    as a record; a row delivered again (same term, record and part) counts once, with its
    latest version; a null weight adds 0; an empty table gives no rows.
    """
    rows = df.select(
        F.col(term).alias("term"),
        F.col(record).alias("record"),
        F.col(part).alias("part"),
        F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("weight"),
        F.col(version).alias("version"),
    ).where("term is not null")
    ranges = rows.repartitionByRange(parallelism(df.sparkSession, df.count()), "term", "record")
    ordered = ranges.sortWithinPartitions("term", "record", "part", F.desc("version")).drop("version")
    parts = ordered.mapInArrow(scan_runs, _SCHEMA)
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("occurrences", "n_rows", "n_docs")])


def marks(df: DataFrame, term: str, record: str, counted: DataFrame) -> DataFrame:
    """Adds ``marks``: ``rare`` for terms of one record, ``common`` for terms in more than half of all records with a term.

    With a single record every term is both.
    """
    total = df.where(F.col(term).isNotNull()).select(F.col(record).alias("r")).agg(F.countDistinct("r").alias("n")).scalar()
    return counted.withColumn(
        "marks",
        F.array_compact(
            F.array(F.when(F.col("n_docs") == 1, F.lit("rare")), F.when(F.col("n_docs") * 2 > total, F.lit("common")))
        ),
    )
