"""Most similar vectors for every vector: additive quantisation, lookup-table scoring, exact reranking."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsearch.session import parallelism, stored

#: The quantiser is fitted on about this many distinct vectors, or on ``FIT_EACH`` for every first-level codeword if that is more; every vector is indexed.
FIT_SAMPLE, FIT_EACH = 16_384, 16
#: Vectors a cell should hold. Cells grow in number with the collection: by more first-level codewords, then by as many second-level ones as are needed, and so on.
CELL_SIZE = 512
MAX_FIRST = 2_048
#: A cell with more vectors than this, as far as the sample shows, is cut into parts that are compared pair by pair, at most ``MAX_PARTS``.
MAX_CELL, MAX_PARTS = 4_096, 256
#: Codewords of every further level, and number of levels after the first.
FINE, LEVELS = 256, 6
#: Beam width of the encoder, and number of cells in which a vector is kept, with one level of cells and with more.
BEAM, SPILL, SPILL_DEEP = 4, 3, 4
#: Candidates of a vector that are reranked exactly at first, and by how much a looked-up cosine may fall short of the least wanted one.
RERANK, SLACK = 512, 0.12
#: Rows of a shuffle partition of cells, about.
CELL_ROWS = 8_000
#: Documents of one exact vector that are named with it, at least, and always more than are wanted; a class with more is expanded by a join.
NAMED = 7


@dataclass(frozen=True)
class Quantiser:
    """Full-dimensional codebooks. A vector is the sum of one codeword per book; ``prefix`` levels name its cell."""

    books: list[np.ndarray]
    prefix: int

    def cross(self) -> list[list[np.ndarray]]:
        """Products of the codewords of each book with those of the books before it."""
        return [[self.books[i] @ b.T for i in range(m)] for m, b in enumerate(self.books)]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Codewords and each vector's codeword."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    near = np.zeros(len(x), np.int64)
    for r in range(rounds + 1):
        half = (c * c).sum(1) / 2
        for lo in range(0, len(x), 4096):
            near[lo : lo + 4096] = np.argmax(x[lo : lo + 4096] @ c.T - half, axis=1)
        if r == rounds:
            break
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        some = n > 0
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c, near


def fit(sample: np.ndarray, total: int, seed: int = 7) -> Quantiser:
    """Codebooks trained one after the other on what the ones before leave over."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    sizes = cell_levels(total, max(1, len(rest) // 4))
    books = []
    for k in sizes + [min(FINE, max(1, len(rest) // 4))] * (LEVELS + 1 - len(sizes)):
        c, near = _kmeans(rest, k, 5, rng)
        books.append(c)
        rest = rest - c[near]
    return Quantiser(books, len(sizes))


def cell_levels(total: int, most: int) -> list[int]:
    """Codewords of the levels that name cells, at most ``most`` each: their product is about ``total / CELL_SIZE``, at any size."""
    left = max(1, total // CELL_SIZE)
    sizes = [min(left, MAX_FIRST, most)]
    left = -(-left // sizes[0])
    while left > 1 and most > 1 and len(sizes) < LEVELS:
        sizes.append(min(left, FINE, most))
        left = -(-left // sizes[-1])
    return sizes


def crowded(q: Quantiser, sample: np.ndarray, total: int) -> dict[int, int]:
    """Parts of the cells that have more than ``MAX_CELL`` of ``total`` vectors, judged from the sample: at most one for each of its vectors."""
    coarse = Quantiser(q.books[: q.prefix], q.prefix)
    cross = coarse.cross()
    cells = [encode(coarse, cross, sample[lo : lo + 1024])[2] for lo in range(0, len(sample), 1024)]
    cell, n = np.unique(np.concatenate(cells), return_counts=True)
    size = n * (total / len(sample))
    return {int(c): int(min(MAX_PARTS, np.ceil(s / MAX_CELL))) for c, s in zip(cell, size) if c >= 0 and s > MAX_CELL}


def encode(q: Quantiser, cross: list[list[np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam-search codes of unit vectors, a stored norm, and the best cells.

    The stored norm of a vector y with the sum s is <y, s>, from the squared norm of s and the
    beam's error. A looked-up <x, s> divided by it estimates <x, y> without bias, and
    exactly at x = y, however coarse the code.

    A level extends every beam by every codeword and keeps the ``BEAM`` sums nearest to the
    vector. The beams after the cell's levels are the cells, nearest first, -1 for none.
    """
    n = len(x)
    codes = np.zeros((n, 1, 0), np.int64)
    error = np.ones((n, 1), np.float32)
    cells = np.zeros((n, 1), np.int64)
    rows = np.arange(n)[:, None]
    for m, book in enumerate(q.books):
        gain = (book * book).sum(1)[None, :] - 2 * (x @ book.T)
        cost = error[:, :, None] + gain[:, None, :]
        for i in range(m):
            cost += 2 * cross[m][i][codes[:, :, i]]
        flat = cost.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        beam, word = best // len(book), best % len(book)
        codes = np.concatenate([codes[rows, beam], word[:, :, None]], axis=2)
        error = np.take_along_axis(flat, best, 1)
        if m + 1 == q.prefix:
            cells = codes[:, :, 0]
            for level in range(1, q.prefix):
                cells = cells * len(q.books[level]) + codes[:, :, level]
    spill = SPILL if q.prefix == 1 else SPILL_DEEP
    if cells.shape[1] < spill:
        cells = np.concatenate([cells, np.full((n, spill - cells.shape[1]), -1)], axis=1)
    code = codes[:, 0]
    total = sum(b[code[:, m]] for m, b in enumerate(q.books))
    norm = (1 + (total * total).sum(1) - error[:, 0]) / 2
    return code.astype(np.int16), np.maximum(norm, 1e-3).astype(np.float32), cells[:, :spill]


def _matrix(c: pa.ListArray, dim: int) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def _lists(parts: list[np.ndarray] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    parts = list(parts)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def valid_vectors(df: DataFrame, doc_id: str, vec: str, dim: int) -> DataFrame:
    """``(id, vec, class)`` of usable vectors: ``dim`` finite numbers, not all zero. ``class`` is a hash of the exact vector."""
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    good = (
        F.col("id").isNotNull()
        & (F.size("vec") == dim)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    return rows.where(F.coalesce(good, F.lit(False))).withColumn("class", F.xxhash64("vec"))


def fit_on(rows: DataFrame, total: int, dim: int) -> tuple[Quantiser, dict[int, int]] | None:
    """Fit on a hash sample of the distinct ones of ``total`` vectors, and the parts of crowded cells; None without vectors.

    The sample, at most twice ``FIT_SAMPLE`` or ``FIT_EACH`` x ``MAX_FIRST`` vectors, meets in one task; the driver gets the codebooks.
    """
    if not total:
        return None
    most = max(FIT_SAMPLE, FIT_EACH * min(MAX_FIRST, total // CELL_SIZE))
    share = min(1.0, most / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("class")
            sample = _unit(_matrix(t.column("vec").combine_chunks(), dim))
            q = fit(sample, total)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((q.books, q.prefix, crowded(q, sample, total)))], pa.binary())], names=["made"])

    some = rows.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))).dropDuplicates(["class"]).limit(2 * most)
    for sample in (some, rows.limit(most)):
        made = sample.select("class", "vec").repartition(1).mapInArrow(run, "made binary").collect()
        if made:
            break
    books, prefix, parts = pickle.loads(made[0]["made"])
    return Quantiser(books, prefix), parts


def _spread(cell: np.ndarray, home: np.ndarray, kind: np.ndarray, parts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """``(row, cell, asks, answers, parted)``: where each placed row goes.

    A class lies in one part of a crowded cell. It answers beside every part and, where it is at home,
    asks every part, so all pairs meet, in as many tasks as there are pairs of parts.
    """
    n = np.array([parts.get(int(c), 1) for c in cell], np.int64)
    own = kind % n
    row = np.repeat(np.arange(len(cell)), n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    asks = home[row] & (other == own[row])
    ends = [np.stack([row, other, own[row], asks, np.ones(len(row), bool)], axis=1)]
    far = home[row] & (other != own[row])
    ends.append(np.stack([row[far], own[row[far]], other[far], np.ones(far.sum(), bool), np.zeros(far.sum(), bool)], axis=1))
    row, asking, answering, asks, answers = np.concatenate(ends).T
    key = (cell[row] * MAX_PARTS + asking) * MAX_PARTS + answering
    return row, key, asks.astype(bool), answers.astype(bool), n[row] > 1


def place(q: Quantiser, dim: int, named: int, parts: dict[int, int] | None = None):
    """mapInArrow function over ``(id, vec, class)`` sorted by (class, id): codes each class once and puts it into its cells.

    Copies of a vector in a partition become one row with their ``named`` least ids before
    anything is shuffled.
    """
    parts = parts or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = q.cross()

        def emit(classes: list[int], ids: list[list[int]], x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(classes), 1024):
                own = slice(lo, lo + 1024)
                code, norm, cells = encode(q, cross, _unit(x[own]))
                at, slot = np.nonzero(cells >= 0)
                kind = np.array(classes[own], np.int64)
                row, cell, asks, answers, parted = _spread(cells[at, slot].astype(np.int64), slot == 0, kind[at], parts)
                at = at[row]
                vectors = x[own][at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell),
                        pa.array(asks),
                        pa.array(answers),
                        pa.array(parted),
                        pa.array(kind[at]),
                        _lists([np.array(ids[lo + i], np.int64) for i in at], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * code.shape[1]), pa.array(code[at].ravel())),
                        pa.array(norm[at]),
                    ],
                    names=["cell", "asks", "answers", "parted", "class", "ids", "vec", "code", "norm"],
                )

        held: tuple[int, list[int], np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column("class").to_numpy()
            doc = b.column("id").to_numpy()
            x = _matrix(b.column("vec"), dim)
            start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            stop = np.append(start[1:], len(kind))
            classes, ids, vectors = [], [], []
            for s, e in zip(start, stop):
                some = doc[s:e] if e - s == 1 else np.unique(doc[s:e])
                if held is not None and held[0] == kind[s]:
                    held = (held[0], sorted({*held[1], *some[:named].tolist()})[:named], held[2])
                    continue
                if held is not None:
                    classes.append(held[0])
                    ids.append(held[1])
                    vectors.append(held[2])
                held = (int(kind[s]), some[:named].tolist(), x[s])
            if classes:
                yield from emit(classes, ids, np.stack(vectors))
        if held is not None:
            yield from emit([held[0]], [held[1]], held[2][None, :])

    return run


_PLACED = "cell long, asks boolean, answers boolean, parted boolean, class long, ids array<long>, vec array<float>, code array<short>, norm float"


def _looked_up(q: Quantiser, x: np.ndarray, code: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Estimated cosines of unit vectors ``x`` with coded ones: one table per book, one lookup per code, divided by the stored norm."""
    total = np.zeros((len(x), len(code)), np.float32)
    for m, book in enumerate(q.books):
        used, at = np.unique(code[:, m], return_inverse=True)
        total += np.take(x @ book[used].T, at, axis=1)
    return total / norm


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows ``a`` with the rows ``b`` of ``x`` in double precision, to 6 decimals."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 16384):
        out[lo : lo + 16384] = np.einsum("ij,ij->i", x[a[lo : lo + 16384]], x[b[lo : lo + 16384]])
    return np.round(out, 6)


def score_cells(q: Quantiser, dim: int, k: int, least: float, named: int):
    """mapInArrow function over placed rows sorted by (cell, class): neighbours of the classes at home in each cell.

    Gives rows ``(class, a, b, cos, parted)``: ``a`` is null for classes with ``named`` or more ids, which are expanded
    later; ``parted`` rows come from one of several parts of a cell.
    """

    def cell(t: pa.Table) -> list[tuple]:
        kind = t.column("class").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        ids_col = t.column("ids").to_pylist()
        stop = np.append(start[1:], len(kind))
        ids = [sorted({i for r in range(s, e) for i in ids_col[r]})[:named] for s, e in zip(start, stop)]
        one = t.take(pa.array(start)).combine_chunks()
        pick = lambda c: one.column(c).chunk(0)
        raw = _matrix(pick("vec"), dim).astype(np.float64)
        full = raw / np.linalg.norm(raw, axis=1)[:, None]
        code = _matrix(pick("code"), len(q.books))
        norm = pick("norm").to_numpy()
        home = np.flatnonzero(pick("asks").to_numpy(zero_copy_only=False))
        silent = ~pick("answers").to_numpy(zero_copy_only=False)
        parted = bool(pick("parted")[0].as_py())
        kind = kind[start]
        least_id = np.array([i[0] for i in ids])
        out = []
        for lo in range(0, len(home), 512):
            own = home[lo : lo + 512]
            est = _looked_up(q, full[own].astype(np.float32), code, norm)
            est[np.arange(len(own)), own] = -2
            est[:, silent] = -2
            est[est < least - SLACK] = -2
            r = min(RERANK, est.shape[1])
            short = np.argpartition(-est, r - 1, axis=1)[:, :r]
            row, col = np.nonzero(np.take_along_axis(est, short, 1) > -2)
            other = short[row, col]
            cos = _exact(full, own[row], other)
            # beyond the first ones, all whose estimate comes near the k-th best cosine
            first = np.full(short.shape, -2.0)
            first[row, col] = cos
            floor = np.maximum(np.partition(first, -min(k, r), axis=1)[:, -min(k, r)], least) - SLACK
            np.put_along_axis(est, short, -2, axis=1)
            more, further = np.nonzero(est >= floor[:, None])
            row, other = np.concatenate([row, more]), np.concatenate([other, further])
            cos = np.concatenate([cos, _exact(full, own[more], further)])
            good = cos >= least
            row, other, cos = row[good], other[good], cos[good]
            order = np.lexsort((least_id[other], -cos, row))
            row, other, cos = row[order], other[order], cos[order]
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            for p, x in enumerate(own):
                mine = ids[x]
                s, e = ends[p], min(ends[p + 1], ends[p] + k)
                if s == e and len(mine) == 1:
                    continue
                near = [(-1.0, i) for i in mine] + [(-cos[y], i) for y in range(s, e) for i in ids[other[y]]]
                near.sort()
                if len(mine) >= named:
                    out += [(int(kind[x]), None, i, -c, parted) for c, i in near[: k + named]]
                else:
                    for a in mine:
                        out += [(int(kind[x]), a, i, -c, parted) for c, i in [v for v in near if v[1] != a][:k]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = t.column("cell").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            for s, e in zip(start, np.append(start[1:], len(cells))):
                if got := cell(t.slice(s, e - s)):
                    cls, a, b, cos, parted = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cos, pa.float64()), pa.array(parted)],
                        names=["class", "a", "b", "cos", "parted"],
                    )

        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cells = b.column("cell").to_numpy()
            last = int(np.searchsorted(cells, cells[-1]))
            if last:
                yield from rows(pa.concat_tables([*held, t.slice(0, last)]).combine_chunks())
                held = [t.slice(last)]
            elif held and held[-1].column("cell")[-1].as_py() != int(cells[0]):
                yield from rows(pa.concat_tables(held).combine_chunks())
                held = [t]
            else:
                held.append(t)
        if held:
            yield from rows(pa.concat_tables(held).combine_chunks())

    return run


def similar_vectors(df: DataFrame, doc_id: str, vec: str, dim: int, k: int, least: float) -> DataFrame:
    """For every vector its ``k`` most similar others with a cosine of at least ``least``: ``(a, b, cos)``.

    Cosines are exact in double precision, rounded to 6 decimals; equal ones rank by smaller
    id. Candidates come from the cells a vector is kept in (its ``SPILL`` nearest, or ``SPILL_DEEP`` of several levels), scored by
    table lookup on the codes; the ``RERANK`` best and all others within ``SLACK`` of the ``k``-th best are computed exactly.
    Cells hold about ``CELL_SIZE`` vectors however many there are; crowded ones are cut into parts.

    Defined cases: null, incomplete, all-zero, NaN or infinite vectors and null ids take no
    part; an id delivered again with the same vector counts once; ids of equal vectors are
    neighbours with cosine 1; fewer than ``k`` similar vectors give fewer rows; an empty
    table gives none.
    """
    rows = valid_vectors(df, doc_id, vec, dim)
    total = rows.count()
    fitted = fit_on(rows, total, dim)
    spark = df.sparkSession
    if fitted is None:
        return spark.createDataFrame([], "a long, b long, cos double")
    q, parts = fitted
    named = max(NAMED, k + 1)
    placed = rows.select("id", "vec", "class").sortWithinPartitions("class", "id").mapInArrow(place(q, dim, named, parts), _PLACED)
    cells = placed.repartition(parallelism(spark, total * SPILL, CELL_ROWS), "cell").sortWithinPartitions("cell", "class")
    found = stored(cells.mapInArrow(score_cells(q, dim, k, least, named), "class long, a long, b long, cos double, parted boolean"), "neighbours")
    direct = found.where("a is not null and not parted").select("a", "b", "cos")
    if parts:
        some = found.where("a is not null and parted").select("a", "b", "cos").distinct()
        direct = direct.unionByName(_best(some, k))
    many = found.where("a is null").select("class", "b", "cos")
    if many.isEmpty():
        return direct
    # a class of many copies: its ids are never gathered, each row meets the class's short list
    near = many.groupBy("class").agg(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("c"), "b"))).alias("near"))
    ids = rows.select(F.col("id").alias("a"), "class").distinct().join(F.broadcast(near) if near.count() < 10_000 else near, "class")
    best = F.slice(F.filter("near", lambda x: x["b"] != F.col("a")), 1, k)
    wide = ids.select("a", F.explode(best).alias("n")).select("a", F.col("n.b").alias("b"), (-F.col("n.c")).alias("cos"))
    return direct.unionByName(wide)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` first pairs ``(a, b, cos)`` of every ``a``."""
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def scan_for(dim: int, ids: np.ndarray, vectors: np.ndarray, k: int):
    """mapInArrow function over ``(id, vec, class)``: the ``k`` best rows of each batch for a block of query vectors.

    Products of all rows with all queries preselect; every row that rounding may bring
    among the ``k`` best is kept, however many are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                # a row given again counts once
                both = np.stack([b.column("id").to_numpy(), b.column("class").to_numpy()], axis=1)
                once, first = np.unique(both, axis=0, return_index=True)
                doc = once[:, 0]
                raw = _matrix(b.column("vec"), dim)[first].astype(np.float64)
                full = raw / np.linalg.norm(raw, axis=1)[:, None]
                for lo in range(0, len(ids), 256):
                    own, block = ids[lo : lo + 256], want[lo : lo + 256]
                    near = block @ full.T
                    near[own[:, None] == doc[None, :]] = -2
                    n = min(k, near.shape[1])
                    floor = np.maximum(np.partition(near, -n, axis=1)[:, -n], -1.5) - 2e-6
                    row, pick, cos = [], [], []
                    for r in range(len(own)):
                        some = np.flatnonzero(near[r] >= floor[r])
                        c = np.round(np.einsum("rd,d->r", full[some], block[r]), 6)
                        best = np.lexsort((doc[some], -c))[:k]
                        row.append(np.full(len(best), r))
                        pick.append(some[best])
                        cos.append(c[best])
                    row, pick, cos = np.concatenate(row), np.concatenate(pick), np.concatenate(cos)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(doc[pick]), pa.array(cos)], names=["a", "b", "cos"])

    return run


#: Query vectors sent to the executors at a time.
QUERY_BLOCK = 4096


def search(df: DataFrame, queries: DataFrame, doc_id: str, vec: str, dim: int, k: int) -> DataFrame:
    """The ``k`` most similar rows of ``df`` for every query vector: ``(a, b, cos)``, ranked as in :func:`similar_vectors`.

    Queries are a stated subset with its own ids and go through the whole table in blocks of
    ``QUERY_BLOCK`` vectors. One block is in memory at a time, the results of several are written one
    after the other. Neither cells nor codes are used, so dissimilar neighbours are found
    as well and the result is exact.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, doc_id, vec, dim)
    asked = valid_vectors(queries, doc_id, vec, dim).groupBy("id").agg(F.first("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for i in range(blocks):
        t = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        ids, vectors = t.column("id").to_numpy(), _matrix(t.column("vec").combine_chunks(), dim).astype(np.float64)
        got = _best(rows.mapInArrow(scan_for(dim, ids, vectors, k), "a long, b long, cos double").distinct(), k)
        got = got if blocks == 1 else stored(got, "found")
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], "a long, b long, cos double") if found is None else found
