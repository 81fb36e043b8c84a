"""Vector retrieval: TF-IDF vectors, latent semantic indexing, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsearch.functions.text import words_by_pattern
from quillsearch.operators.dictionary import dense_ids
from quillsearch.operators.index import document_map, occurrences
from quillsearch.operators.retrieve import best_of_terms
from quillsearch.session import has_table, parallelism, stored

#: Steps of the block Lanczos iteration, each a pass over all documents, and columns of a step beyond the components wanted.
STEPS, MORE_COLUMNS = 7, 32
#: Terms whose rows of a matrix are stored together, and bytes of a matrix that are broadcast at a time: a larger one goes in groups of columns.
TERM_BLOCK, BROADCAST_BYTES = 4_096, 64 << 20
#: Bytes of all vectors of the iteration up to which they are combined on the driver; larger ones stay packed tables, with the same result.
DRIVER_BYTES = 256 << 20
#: Documents multiplied at a time.
DOC_BLOCK = 500
#: Query vectors sent to the executors at a time.
QUERY_BLOCK = 2_048
#: Weights of at most so many terms are broadcast.
BROADCAST_TERMS = 400_000


def term_weights(docs: DataFrame) -> tuple[DataFrame, int]:
    """``(term, idf)`` with idf = ln((1 + n) / (1 + df)) + 1 over all documents with a text, and n."""
    n = docs.where("doc_id is not null and text is not null").count()
    df = occurrences(docs, words_by_pattern).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", (F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")), n


def tfidf_vectors(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``(doc_id, term, w)``: tf times idf, each document scaled to length 1; unknown words are dropped."""
    tf = occurrences(docs, words_by_pattern).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = tf.join(weights, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """``(qid, rank, doc_id, score)`` by cosine of TF-IDF vectors, which is retrieval at full rank.

    Term counts are stored once. Only those of query terms are shuffled, to be packed as in keyword retrieval
    (:func:`~quillsearch.operators.retrieve.best_of_terms`); no pair of query and document is. Weights of up to ``BROADCAST_TERMS`` terms are broadcast to
    the counts for the documents' lengths, more meet them by a shuffle.
    """
    n = docs.where("doc_id is not null and text is not null").count()
    tf = stored(occurrences(docs, words_by_pattern).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    idf = (F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    weights = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf, "df"), "weights")
    sent = F.broadcast(weights) if weights.count() <= BROADCAST_TERMS else weights
    w = F.col("tf") * F.col("idf")
    norms = stored(tf.join(sent, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm")), "lengths")
    asked = tfidf_vectors(queries.select(F.col("qid").alias("doc_id"), "text"), weights.select("term", "idf"))
    asked = asked.select(F.col("doc_id").alias("qid"), "term", F.col("w").alias("qtf")).join(weights, "term")

    def hits(words: DataFrame, parts: int) -> DataFrame:
        rows = tf.join(F.broadcast(words), "term").select("doc_id", "no", w.alias("w")).repartition(parts, "doc_id")
        return rows.join(norms, "doc_id").select("doc_id", "no", (F.col("w") / F.col("norm")).alias("s"))

    return best_of_terms(asked.select("qid", "term", "qtf", "df", "idf"), hits, k, decimals)


def knn(vectors: DataFrame, queries: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """Exact nearest neighbours: ``(qid, rank, id, score)`` with score = minus the squared distance.

    ``vectors (id, vec)``, ``queries (id, vec)``; null vectors and null ids take no part, equal
    scores rank by id, fewer than ``k`` vectors give fewer rows. Queries are a stated set and go
    out in blocks of ``QUERY_BLOCK`` vectors; each task keeps its ``k`` best per query. One block is in
    memory at a time, the results of several are written one after the other.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    out = "qid long, id long, score double"
    spark = vectors.sparkSession
    good = "id is not null and vec is not null"
    asked = queries.where(good).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = vectors.where(good).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = None
    for i in range(blocks):
        t = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        ids = t.column("id").to_numpy()
        x = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        got = rows.mapInArrow(_nearest(ids, x, k, decimals), out).withColumn("rank", F.row_number().over(order).cast("long"))
        got = got.where(F.col("rank") <= k).select("qid", "rank", "id", "score")
        got = got if blocks == 1 else stored(got, "nearest")
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], "qid long, rank long, id long, score double") if found is None else found


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, decimals: int):
    """mapInArrow function: the ``k`` nearest of every query in the partition. After the first rows only those are looked at that may be nearer than a query's ``k``-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
        last = np.full(len(ids), -np.inf)
        square, slack = (x * x).sum(1), 10.0**-decimals
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                y = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                doc = b.column("id").to_numpy()
                yy = (y * y).sum(1)
                largest = yy[np.isfinite(yy)].max(initial=0)
                # single precision preselects unless it would overflow
                single = bool((yy < 1e30).all() and (square < 1e30).all())
                kind, error = (np.float32, 6e-8 * (x.shape[1] + 32)) if single else (np.float64, 1e-12)
                near, to = x.astype(kind, copy=False), np.ascontiguousarray(y.astype(kind, copy=False).T)
                for lo in range(0, len(ids), 256):
                    q = x[lo : lo + 256]
                    # products preselect, differences give the score to the last digits
                    far = near[lo : lo + 256] @ to
                    far *= -2
                    far += yy.astype(kind)
                    far += square[lo : lo + 256, None].astype(kind)
                    off = error * (square[lo : lo + 256] + largest)
                    most = -last[lo : lo + 256]
                    if len(new := np.flatnonzero(~np.isfinite(most))):
                        n = min(k, far.shape[1])
                        most[new] = np.partition(far[new], n - 1, axis=1)[:, n - 1] + off[new]
                    # every row that rounding may bring among the k nearest is kept, however many are equal; NaN compares as kept
                    some = ~(far > (most + off + slack).astype(kind)[:, None])
                    for r in np.flatnonzero(some.any(1)).tolist():
                        own = np.flatnonzero(some[r])
                        d = y[own] - q[r]
                        name, s = doc[own], -np.round((d * d).sum(1), decimals) + 0.0
                        if best[lo + r] is not None:
                            name, s = np.concatenate([best[lo + r][0], name]), np.concatenate([best[lo + r][1], s])
                        order = np.lexsort((name, -s))[:k]
                        best[lo + r] = (name[order], s[order])
                        if len(order) == k:
                            last[lo + r] = s[order[-1]]
        for lo in range(0, len(ids), 1000):
            got = [(i, *best[i]) for i in range(lo, min(len(ids), lo + 1000)) if best[i] is not None]
            if got:
                qid = np.repeat(ids[[i for i, _, _ in got]], [len(s) for _, _, s in got])
                columns = [qid, np.concatenate([name for _, name, _ in got]), np.concatenate([s for _, _, s in got])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "id", "score"])

    return run


@dataclass(frozen=True)
class LsiIndex:
    """Latent semantic index: term weights with their projections ``(term, idf, v)``, and document vectors ``(doc_id, vec)`` of length 1."""

    terms: DataFrame
    docs: DataFrame
    components: int
    paths: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, components: int = 128) -> LsiIndex:
        """Truncated singular value decomposition of all documents and all terms.

        Block Lanczos iteration from a fixed random start: every step multiplies a block of vectors with the
        documents and their transpose, in one pass without a shuffle of documents, and makes it
        orthogonal to the blocks before; the singular vectors are taken from the space of all blocks.
        Where that is the whole space, as in small collections, the result is exact. ``components``
        is cut to what documents and terms allow; ValueError for none.
        """
        weights, n = term_weights(docs)
        weights = stored(weights, "weights")
        ids = stored(dense_ids(weights), "term-numbers")
        n_terms = ids.count()
        if not n:
            raise ValueError("no documents")
        most = min(components, n - 1, n_terms - 1)
        if most < 1:
            raise ValueError("too few documents or terms for one component")
        tf = occurrences(docs, words_by_pattern).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        rows = tf.join(weights.join(ids, "term"), "term").select("doc_id", "term_id", (F.col("tf") * F.col("idf")).alias("w"))
        rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct("term_id", "w")).alias("x"))
        rows = stored(rows.select("doc_id", F.col("x.term_id").alias("t"), F.col("x.w").alias("w")), "lsi-rows")
        vectors = _singular_vectors(rows, n_terms, most)
        found = vectors.mapInArrow(_term_rows(n_terms), "term_id long, v array<float>")
        terms = stored(weights.join(ids, "term").join(found, "term_id").select("term", "idf", "v"), "lsi-terms")
        paths = stored(document_map(docs), "paths") if "doc_path" in docs.columns else None
        return LsiIndex(terms, stored(_folded_in(rows, vectors, n_terms, most), "lsi-docs"), most, paths)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/lsi-terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/lsi-docs")
        if self.paths is not None:
            self.paths.write.mode("overwrite").parquet(f"{path}/lsi-paths")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LsiIndex:
        terms = spark.read.parquet(f"{path}/lsi-terms")
        paths = spark.read.parquet(f"{path}/lsi-paths") if has_table(spark, f"{path}/lsi-paths") else None
        return LsiIndex(terms, spark.read.parquet(f"{path}/lsi-docs"), len(terms.select("v").head()[0]), paths)

    @staticmethod
    def has_artifacts(spark: SparkSession, path: str) -> bool:
        return has_table(spark, f"{path}/lsi-terms")

    def encode(self, queries: DataFrame) -> DataFrame:
        """``(doc_id, vec)`` of query texts; a query without a known word has no vector."""
        return _project(tfidf_vectors(queries, self.terms.select("term", "idf")), self.terms)

    def query(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``(qid, rank, doc_id, score)`` of ``queries (qid, text)``, score = minus the squared distance, from -4 to 0."""
        names = stored(dense_ids(queries.select(F.col("qid").alias("term"))).toDF("qid", "n"), "query-numbers")
        asked = queries.join(names, "qid").select(F.col("n").alias("doc_id"), "text")
        # written once, for every block of queries reads them
        vectors = stored(self.encode(asked).toDF("id", "vec"), "query-vectors")
        got = knn(self.docs.toDF("id", "vec"), vectors, k)
        return got.join(names, got["qid"] == names["n"]).select(names["qid"], "rank", F.col("id").alias("doc_id"), "score")


_BLOCKS = "part int, block long, m binary"


def _pack(part: int, block: int, m: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([np.ascontiguousarray(m, np.float64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "m"])


def _width_of(block: int, n_terms: int) -> int:
    """Terms of a block."""
    return min(TERM_BLOCK, n_terms - block * TERM_BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for b in batches:
        for part, block, m in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), b.column("m")):
            yield part, block, np.frombuffer(m.as_buffer(), np.float64).reshape(_width_of(block, n_terms), -1)


def _random_blocks(n_terms: int, width: int):
    """mapInArrow function over block numbers: normal deviates, the same for a block on every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("id").to_pylist():
                yield _pack(0, block, np.random.default_rng([17, block]).standard_normal((_width_of(block, n_terms), width)))

    return run


def _gathered(n_terms: int, act):
    """mapInArrow function over packed rows sorted by (block, part): ``act(block, matrices)`` of every block, in the order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for _, block, m in _unpacked(batches, n_terms):
            if held and block != last:
                yield from act(last, held)
                held = []
            last = block
            held.append(m)
        if held:
            yield from act(last, held)
        yield from act(None, [])

    return run


def _together(tables: list[DataFrame], n_terms: int, act, schema: str = _BLOCKS) -> DataFrame:
    """``act`` on the matrices that several packed tables have for the same block."""
    every = None
    for i, t in enumerate(tables):
        t = t.select(F.lit(i).alias("part"), "block", "m")
        every = t if every is None else every.unionByName(t)
    tasks = min(parallelism(every.sparkSession), -(-n_terms // TERM_BLOCK))
    return every.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(_gathered(n_terms, act), schema)


def _products(tables: list[DataFrame] | list[np.ndarray], n_terms: int) -> np.ndarray:
    """Products of the columns of all tables, side by side, with those of the last: summed in each partition, then here."""
    if isinstance(tables[-1], np.ndarray):
        return np.concatenate([t.T @ tables[-1] for t in tables])
    total: list[np.ndarray] = []

    def act(block: int | None, m: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if block is None:
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()], pa.binary())], names=["m"])
            return
        part = np.concatenate(m, axis=1).T @ m[-1]
        total[:] = [total[0] + part if total else part]

    sums = _together(tables, n_terms, act, "m binary")
    # few rows come at once, many one after the other
    few = -(-n_terms // TERM_BLOCK) <= 16
    out = 0.0
    for r in sums.collect() if few else sums.toLocalIterator():
        out = out + np.frombuffer(r["m"], np.float64)
    return out


def _combined(tables: list[DataFrame] | list[np.ndarray], n_terms: int, by: np.ndarray) -> DataFrame | np.ndarray:
    """The columns of all tables, side by side, times a matrix."""
    if isinstance(tables[-1], np.ndarray):
        ends = np.cumsum([t.shape[1] for t in tables])
        return sum(t @ by[e - t.shape[1] : e] for t, e in zip(tables, ends))

    def act(block: int | None, m: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if block is not None:
            yield _pack(0, block, np.concatenate(m, axis=1) @ by)

    return stored(_together(tables, n_terms, act), "lsi-block")


def _column_groups(table: DataFrame | np.ndarray, n_terms: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The matrix in groups of columns of at most ``BROADCAST_BYTES``, at least one column, brought to the driver one group after the other."""
    each = max(1, BROADCAST_BYTES // (8 * n_terms))
    for lo in range(0, width, each):
        hi = min(width, lo + each)
        if isinstance(table, np.ndarray):
            yield lo, np.ascontiguousarray(table[:, lo:hi])
            continue

        def cut(batches: Iterator[pa.RecordBatch], lo: int = lo, hi: int = hi) -> Iterator[pa.RecordBatch]:
            for part, block, m in _unpacked(batches, n_terms):
                yield _pack(part, block, m[:, lo:hi])

        whole = np.empty((n_terms, hi - lo))
        # together no more than the group's bytes, or one column's
        for r in table.select("part", "block", "m").mapInArrow(cut, _BLOCKS).collect():
            at = r["block"] * TERM_BLOCK
            own = np.frombuffer(r["m"], np.float64).reshape(-1, hi - lo)
            whole[at : at + len(own)] = own
        yield lo, whole


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, terms, rows)``: some documents as a dense matrix over the terms they have, scaled to length 1."""
    for whole in batches:
        for lo in range(0, whole.num_rows, DOC_BLOCK):
            b = whole.slice(lo, DOC_BLOCK)
            lists = b.column("t")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))
            terms, col = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            x = np.zeros((b.num_rows, len(terms)))
            x[row, col] = b.column("w").flatten().to_numpy(zero_copy_only=False)
            yield b.column("doc_id").to_numpy(), terms, x / np.linalg.norm(x, axis=1)[:, None]


def _squared(rows: DataFrame, table: DataFrame | np.ndarray, n_terms: int, width: int) -> DataFrame | np.ndarray:
    """A' A times the given table. Each task adds up its documents' part, one sum a block of terms is shuffled."""
    parts = []
    context = rows.sparkSession.sparkContext
    for lo, group in _column_groups(table, n_terms, width):
        sent = context.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.shape)
            some = False
            for _, terms, x in _dense(batches):
                total[terms] += x.T @ (x @ sent.value[terms])
                some = True
            for block in range(-(-n_terms // TERM_BLOCK) if some else 0):
                yield _pack(0, block, total[block * TERM_BLOCK :][:TERM_BLOCK])

        def add(block: int | None, m: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield _pack(0, block, sum(m))

        made = _together([rows.mapInArrow(run, _BLOCKS)], n_terms, add)
        if isinstance(table, np.ndarray):
            parts += [m for _, m in _column_groups(made, n_terms, group.shape[1])]
        else:
            parts.append(stored(made, "lsi-product"))
        sent.destroy()
    if isinstance(table, np.ndarray):
        return np.concatenate(parts, axis=1)
    return parts[0] if len(parts) == 1 else _combined(parts, n_terms, np.eye(width))


def _whitening(gram: np.ndarray, scale: float) -> np.ndarray:
    """Matrix that makes columns with these products orthonormal; directions far below ``scale`` are noise and left out."""
    value, turn = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-13 * max(scale, value[-1])
    return turn[:, keep] / np.sqrt(value[keep])


def _singular_vectors(rows: DataFrame, n_terms: int, most: int) -> DataFrame:
    """Packed table of the ``most`` first right singular vectors of ``rows (doc_id, t, w)``, by block Lanczos iteration."""
    spark = rows.sparkSession
    width = min(most + MORE_COLUMNS, n_terms)
    start = stored(spark.range(-(-n_terms // TERM_BLOCK)).mapInArrow(_random_blocks(n_terms, width), _BLOCKS), "lsi-start")
    if n_terms * width * STEPS * 8 <= DRIVER_BYTES:
        start = np.concatenate([m for _, m in _column_groups(start, n_terms, width)], axis=1)
    by = _whitening(_products([start], n_terms).reshape(width, width), 0.0)
    table = _combined([start], n_terms, by)
    basis, columns, own, size = [], [], by.shape[1], 0
    while True:
        basis.append(table)
        size += own
        made = _squared(rows, table, n_terms, own)
        inner = _products([*basis, made], n_terms).reshape(-1, own)
        columns.append(inner[:size])
        if len(basis) == STEPS:
            break
        # what the product has outside the space so far; a second time, for rounding leaves errors
        rest = _combined([*basis, made], n_terms, np.concatenate([-inner[:size], np.eye(own)]))
        again = _products([*basis, rest], n_terms).reshape(-1, own)
        gram = again[size:] - again[:size].T @ again[:size]
        by = _whitening(gram, float(np.abs(inner[size:]).max()))
        own = by.shape[1]
        if not own:
            break
        table = _combined([*basis, rest], n_terms, np.concatenate([-again[:size] @ by, by]))
    small = np.zeros((size, size))
    at = 0
    for c in columns:
        small[: len(c), at : at + c.shape[1]] = c
        at += c.shape[1]
    small = np.triu(small) + np.triu(small, 1).T
    value, turn = np.linalg.eigh(small)
    turn = turn[:, ::-1][:, :most] * (value[::-1][:most] > 1e-10 * value[-1])
    made = _combined(basis, n_terms, turn)
    if isinstance(made, np.ndarray):
        packed = [_pack(0, i, made[i * TERM_BLOCK :][:TERM_BLOCK]) for i in range(-(-n_terms // TERM_BLOCK))]
        made = spark.createDataFrame(pa.Table.from_batches(packed), _BLOCKS)
    return made


def _term_rows(n_terms: int):
    """mapInArrow function: packed rows to ``(term_id, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, m in _unpacked(batches, n_terms):
            lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(block * TERM_BLOCK + np.arange(len(m))), lists], names=["term_id", "v"])

    return run


def _folded_in(rows: DataFrame, vectors: DataFrame, n_terms: int, width: int) -> DataFrame:
    """``(doc_id, vec)`` of length 1: every document times the singular vectors; a document orthogonal to all has none."""
    context = rows.sparkSession.sparkContext
    parts = None
    for lo, group in _column_groups(vectors, n_terms, width):
        sent = context.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, lo: int = lo) -> Iterator[pa.RecordBatch]:
            for ids, terms, x in _dense(batches):
                y = x @ sent.value[terms]
                lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(y), lo)), lists], names=["doc_id", "lo", "y"])

        part = stored(rows.mapInArrow(run, "doc_id long, lo long, y array<double>"), "lsi-part")
        parts = part if parts is None else parts.unionByName(part)
        sent.destroy()
    if width * 8 * n_terms > BROADCAST_BYTES:
        lists = F.array_sort(F.collect_list(F.struct("lo", "y")))
        parts = parts.groupBy("doc_id").agg(F.flatten(F.transform(lists, lambda x: x["y"])).alias("y"))
    norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda at, y: at + y * y))
    unit = parts.withColumn("norm", norm).where("norm > 1e-12")
    return unit.select("doc_id", F.transform("y", lambda y: (y / F.col("norm")).cast("float")).alias("vec"))


def _project(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """Sum of each document's weighted term projections, scaled to length 1. Rows of a document stay in its partition."""
    width = len(terms.select("v").head()[0])
    rows = vectors.join(terms.select("term", "v"), "term").select("doc_id", "w", "v")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(_folded(width), "doc_id long, vec array<float>")


def _folded(width: int):
    """mapInArrow function: sums of ``w * v`` over rows sorted by document, scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(width)
        for b in batches:
            if not b.num_rows:
                continue
            doc = b.column("doc_id").to_numpy()
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(doc), width) * b.column("w").to_numpy()[:, None]
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            sums = np.add.reduceat(x, start, axis=0)
            ids = doc[start]
            if last is not None and ids[0] == last:
                sums[0] += total
            elif last is not None:
                ids, sums = np.concatenate([[last], ids]), np.concatenate([total[None, :], sums])
            last, total = ids[-1], sums[-1]
            if len(ids) > 1:
                yield batch(ids[:-1], sums[:-1])
        if last is not None:
            yield batch(np.array([last]), total[None, :])

    def batch(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        norm = np.linalg.norm(x, axis=1)
        ok = norm > 1e-12
        ids, x = ids[ok], (x[ok] / norm[ok, None]).astype(np.float32)
        lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * width, pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["doc_id", "vec"])

    return run
