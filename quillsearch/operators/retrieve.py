"""Batches of ranked keyword queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsearch.functions import scoring
from quillsearch.functions.text import words_by_space
from quillsearch.operators.encoded import EncodedIndex
from quillsearch.operators.index import Index
from quillsearch.session import parallelism, stored

#: Scores are rounded to this many decimals before ranking, so ties don't depend on the order of a sum.
DECIMALS = 6
#: Words of queries that are broadcast at a time, about, and rows of results kept in a task of the exhaustive plan. Query sets with more words go in blocks of whole queries.
BLOCK_TERMS, BLOCK_RESULTS = 200_000, 4_000_000
#: Pairs of query and document a partition of the exhaustive plan should sum, about, and most partitions for them.
PAIRS, MAX_PARTS = 2_000_000, 10_000
#: Postings of a partition, about: few where that leaves cores idle, else many, for small chunks cost more than large ones. Most postings of documents that are scored at a time.
#: Bytes of packed chunks a task goes through, one at a time.
HITS, MOST_HITS, CHUNK, CHUNK_BYTES = 750_000, 2_000_000, 2_500_000, 4 << 30
#: Results a task keeps, about, and rows of query terms up to which nothing is packed.
TASK_RESULTS, FEW_TERMS = 2_000_000, 1_000
#: Results a task keeps at most, about, where only those down to the lowest judged document are kept.
MOST_RESULTS = 8_000_000
#: A word in one of so many documents of a chunk has a whole row of scores.
DENSE = 8
_PARTS = ("docs", "words", "begin", "at", "s")
_CHUNK = ", ".join(f"{c} binary" for c in _PARTS)
_GROUP = "group long, qids array<string>, starts binary, word binary, weight binary, judged array<array<bigint>>, known array<array<double>>"
#: One document in so many of a word's is looked up in the word's list, more are read from a row of scores.
FEW_NAMED = 16
#: A query's first floor comes from a query's terms of highest bound that together have this many documents for each wanted one.
LEAD_DOCS = 20
#: By so much a bound may fall short of the floor, for scores are rounded.
MARGIN = 1e-5


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, term, qtf)`` of ``queries (qid, text)``: a bag, so repeated words weigh more."""
    words = queries.where("qid is not null and text is not null").select("qid", F.explode(words_by_space(F.col("text"))).alias("term"))
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def weighted_terms(index: Index | EncodedIndex, queries: DataFrame, mode: str) -> DataFrame:
    """``(qid, term, qtf, df, max_tf, idf)``, of an encoded index with ``term_id``; words that aren't in the index are dropped. idf is computed once per term."""
    known = index.known(query_terms(queries))
    return known.withColumn("idf", scoring.idf(mode, F.lit(index.n_docs), F.col("df")))


def term_bounds(index: Index | EncodedIndex, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(term, df, max_tf, ub_tfidf, ub_bm25)``: most that a term can add to a score, from its largest count and the shortest document."""
    n, avg, least = F.lit(index.n_docs), F.lit(index.avg_dl), F.lit(max(1, index.min_dl))
    return index.terms.select(
        "term",
        "df",
        "max_tf",
        scoring.tfidf_term(scoring.tfidf_idf(n, F.col("df")), F.col("max_tf")).alias("ub_tfidf"),
        scoring.bm25_term(scoring.bm25_idf(n, F.col("df")), F.col("max_tf"), least, avg, k1, b).alias("ub_bm25"),
    )


def in_blocks(terms: DataFrame, run: Callable[[pa.Table], DataFrame], most_queries: int | None = None) -> DataFrame:
    """Union of ``run(block)`` over blocks of whole queries that are small enough to be broadcast, of at most about ``most_queries``.

    A single block stays a lazy plan. Several are run one after the other and written, so
    that no more than one is in memory at any time.
    """
    few = terms.limit(BLOCK_TERMS + 1).toArrow()
    if few.num_rows <= BLOCK_TERMS and (most_queries is None or pc.count_distinct(few.column("qid")).as_py() <= most_queries):
        return run(few)
    terms = stored(terms, "query-terms")
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("qid").alias("q")).head()
    blocks = max(-(-size["n"] // BLOCK_TERMS), -(-size["q"] // most_queries) if most_queries else 1)
    out = None
    for i in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow()
        got = stored(run(block), "ranked")
        out = got if out is None else out.unionByName(got)
    return out


_TERMS = "qid string, term string, qtf long, idf double, df long"


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    top = scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return top.select("qid", "rank", "doc_id", "score")


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError("k is at least 1")
    return k


def exhaustive_top_k(
    index: Index | EncodedIndex, queries: DataFrame, k: int = 10, mode: str = "bm25", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The rows of :func:`top_k` by the score of every pair of query and document that have a word in common.

    Work follows the number of pairs, which grows with documents times queries. Only postings of query terms are
    shuffled, by document; scores add up inside the partitions, and each gives ``k`` rows a query to the last window.
    """
    mode, k = scoring.checked(mode), _checked(k)
    part = scoring.term(mode, F.col("idf"), F.col("tf"), F.col("dl"), F.lit(index.avg_dl), k1, b) * F.col("qtf")

    def block(t: pa.Table) -> DataFrame:
        spark = queries.sparkSession
        terms = spark.createDataFrame(t, _TERMS)
        words = spark.createDataFrame(pa.table({"term": t.column("term").unique()}), "term string")
        parts = min(MAX_PARTS, parallelism(spark, pc.sum(t.column("df")).as_py() or 0, PAIRS))
        hits = index.hits(words).repartition(parts, "doc_id").join(F.broadcast(terms), "term")
        return _ranked(hits.groupBy("qid", "doc_id").agg(F.round(F.sum(part), DECIMALS).alias("score")), k)

    return in_blocks(weighted_terms(index, queries, mode).select(F.col("qid").cast("string"), "term", "qtf", "idf", "df"), block, max(1, BLOCK_RESULTS // k))


def best_rows(t: pa.Table, hits_of: Callable[[DataFrame, int], DataFrame], k: int, spark: SparkSession, decimals: int = DECIMALS) -> DataFrame:
    """As :func:`best_of_terms` for a few queries in ``t (qid, term, qtf, df, ...)``, which are searched where the rows are, without a table between."""
    t = t.sort_by([("qid", "ascending"), ("term", "ascending")])
    qid, term = (t.column(c).combine_chunks().dictionary_encode() for c in ("qid", "term"))
    query, word = qid.indices.to_numpy(), term.indices.to_numpy()
    first = np.unique(word, return_index=True)[1]
    words, parts = _numbered(spark, t.take(first))
    names = spark.createDataFrame(pa.table({"q": np.arange(len(qid.dictionary)), "qid": qid.dictionary}), "q long, qid string")
    starts = np.searchsorted(query, np.arange(len(qid.dictionary) + 1))
    rows = hits_of(words, parts).select("doc_id", "no", "s").sortWithinPartitions("doc_id")
    run = best_of(starts, word, t.column("qtf").to_numpy().astype(np.float64), len(first), k, decimals)
    found = rows.mapInArrow(run, "q long, rank long, doc_id long, score double").join(F.broadcast(names), "q")
    return _ranked(found.select("qid", "doc_id", "score"), k)


def _numbered(spark: SparkSession, t: pa.Table) -> tuple[DataFrame, int]:
    """``(term, no, ...)`` with the other columns of ``t``, of one row a term, and the number of partitions for their postings."""
    columns = {c: t.column(c).to_numpy().astype(np.float64) for c in t.column_names if c not in ("qid", "term", "qtf", "df")}
    made = pa.table({"term": t.column("term"), "no": np.arange(t.num_rows), **columns})
    words = spark.createDataFrame(made, ", ".join(["term string, no long", *(f"{c} double" for c in columns)]))
    hits = int(pc.sum(t.column("df")).as_py() or 0)
    return words, min(MAX_PARTS, max(1, -(-hits // MOST_HITS), min(spark.sparkContext.defaultParallelism, -(-hits // HITS))))


def best_of_terms(terms: DataFrame, hits_of: Callable[[DataFrame, int], DataFrame], k: int, decimals: int = DECIMALS, judged: DataFrame | None = None) -> DataFrame:
    """``(qid, rank, doc_id, score)``: the ``k`` documents with the largest sums of weight times ``s``, none of them below 0, for the queries in ``terms (qid, term, qtf, df, ...)``.

    ``hits_of(words, parts)`` gives rows ``(doc_id, no, s)`` for ``words (term, no, ...)``, few enough to be broadcast, with the other columns of ``terms`` that
    are the same for all rows of a term, in ``parts`` partitions by document. They are ordered by document, packed in chunks and stored, once for all
    queries. Queries are packed in groups and stored too; the driver has only their words. Each task takes a group through the
    chunks, of which it holds one at a time, so a query's floor holds in all of them. Chunks of more than ``CHUNK_BYTES`` together are cut into parts, whose
    results meet in a window. Query sets of more than ``BLOCK_TERMS`` words go in blocks of whole queries.

    With ``judged (qid, doc_id)`` rows of other documents may be left out, but for one behind the judged, if there is any: metrics need no more
    (:func:`~quillsearch.operators.evaluate.metrics`). Scores of judged documents are computed first, so documents below a query's lowest judged one
    aren't ranked, nor queries that have none among their ``k`` best.
    """
    spark = terms.sparkSession
    # kept until they are stored, else their plan would run twice
    held = terms.persist()
    few = held.limit(min(FEW_TERMS, BLOCK_TERMS) + 1).toArrow()
    if few.num_rows <= min(FEW_TERMS, BLOCK_TERMS):
        held.unpersist()
        return best_rows(few, hits_of, k, spark, decimals)
    terms = stored(held, "query-terms")
    held.unpersist()
    same = [c for c in terms.columns if c not in ("qid", "term", "qtf")]
    t = terms.groupBy("term").agg(*(F.first(c).alias(c) for c in same)).limit(BLOCK_TERMS + 1).toArrow()
    if t.num_rows > BLOCK_TERMS:
        blocks, out = -(-terms.count() // BLOCK_TERMS) + 1, None
        for i in range(blocks):
            block = terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
            got = stored(_best_packed(block, block.select("term", *same).dropDuplicates(["term"]).toArrow(), hits_of, k, decimals, judged), "ranked")
            out = got if out is None else out.unionByName(got)
        return out
    return _best_packed(terms, t, hits_of, k, decimals, judged)


def _best_packed(terms: DataFrame, t: pa.Table, hits_of: Callable[[DataFrame, int], DataFrame], k: int, decimals: int, judged: DataFrame | None) -> DataFrame:
    spark = terms.sparkSession
    words, parts = _numbered(spark, t)
    rows = hits_of(words, parts).select("doc_id", "no", "s").sortWithinPartitions("doc_id")
    chunks = stored(rows.mapInArrow(pack_chunks, _CHUNK), "chunks")
    size = chunks.agg(F.sum(sum((F.length(c) for c in _PARTS), F.lit(0).cast("long")))).head()[0] or 0
    cuts = max(1, -(-size // CHUNK_BYTES))
    own = terms.select("qid", "term", F.col("qtf").cast("double").alias("qtf")).join(F.broadcast(words.select("term", "no")), "term")
    bags = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("no", "qtf"))).alias("bag"))
    sparse = judged is not None and cuts == 1

    def each_of(bags: DataFrame, most: int) -> DataFrame:
        """Every chunk with every group of ``bags (qid, bag, judged, known)``, of at most about ``most`` results."""
        bags = stored(bags, "bags")
        n_queries, cores = bags.count(), spark.sparkContext.defaultParallelism
        groups = max(1, min(n_queries, -(-max(parallelism(spark), -(-n_queries * k // most)) // cores) * cores))
        # equal queries meet in a group
        grouped = bags.withColumn("group", F.pmod(F.xxhash64("bag"), F.lit(groups))).repartition(parallelism(spark), "group").sortWithinPartitions("group")
        flat = grouped.select("group", "qid", F.col("bag.no").alias("word"), F.col("bag.qtf").alias("weight"), "judged", "known")
        each = stored(flat.mapInArrow(pack_queries, _GROUP), "groups").repartitionByRange(groups, "group")
        # the chunks are on the left, so they stream: of the right side a task holds its group
        return chunks.coalesce(cuts).hint("shuffle_replicate_nl").crossJoin(each)

    none = F.array().cast("array<double>").alias("known")
    if sparse:
        lists = judged.where("qid is not null and doc_id is not null").groupBy(F.col("qid").cast("string").alias("qid")).agg(F.collect_set(F.col("doc_id").cast("long")).alias("judged"))
        scored = each_of(bags.join(lists, "qid").select("qid", "bag", "judged", none), MOST_RESULTS).mapInArrow(judged_scores(t.num_rows), "qid string, doc_id long, score double")
        known = stored(scored, "judged").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "doc_id"))).alias("j"))
        every = each_of(bags.join(known, "qid").select("qid", "bag", F.col("j.doc_id").alias("judged"), F.col("j.score").alias("known")), MOST_RESULTS)
    else:
        every = each_of(bags.select("qid", "bag", F.array().cast("array<bigint>").alias("judged"), none), TASK_RESULTS)
    found = every.mapInArrow(best_of_chunks(t.num_rows, k, decimals, sparse), "qid string, rank long, doc_id long, score double")
    return found if cuts == 1 else _ranked(found.select("qid", "doc_id", "score"), k)


def top_k(
    index: Index | EncodedIndex, queries: DataFrame, k: int = 10, mode: str = "bm25", k1: float = 1.2, b: float = 0.75, judged: DataFrame | None = None
) -> DataFrame:
    """``(qid, rank, doc_id, score)``: the ``k`` best documents of every query that any of its words occurs in.

    One plan for all queries (:func:`best_of_terms`). Documents that can't be among the ``k`` best by the bounds of
    their terms aren't scored, which changes no row. Order: score descending, then document id.
    Documents with score 0 are kept. A query without a known word has no rows. With ``judged (qid, doc_id)`` only the rows
    that metrics need are sure to be there: those of judged documents and, if there is any, one behind them.
    """
    mode, k = scoring.checked(mode), _checked(k)
    score = scoring.term(mode, F.col("idf"), F.col("tf"), F.col("dl"), F.lit(index.avg_dl), k1, b)

    def hits(words: DataFrame, parts: int) -> DataFrame:
        return index.hits(words.select("term", *ids)).join(F.broadcast(words), "term").select("doc_id", "no", score.alias("s")).repartition(parts, "doc_id")

    terms = weighted_terms(index, queries, mode)
    ids = [c for c in ("term_id",) if c in terms.columns]
    return best_of_terms(terms.select(F.col("qid").cast("string"), "term", "qtf", "idf", "df", *ids), hits, k, judged=judged)


#: Retrieval under its name in the engine (``wand``).
pruned_top_k = top_k


class _Best:
    """The ``k`` best documents of some queries over chunks of documents that come one after the other.

    Query q has the words ``word[starts[q] : starts[q + 1]]`` with their weights; no score is below 0. A chunk's documents and
    ``k`` results a query are held. The best score a chunk can give a query is known from its largest term scores:
    chunks below the query's floor, the ``k``-th best score so far, are passed over, and inside a chunk
    terms that can't lift a document to the floor name no candidates.

    ``aims``: per query scores of documents, ascending. Of a query's ``k`` best those down to the lowest aim among them are kept
    and one more; a query without an aim among them is given up.
    """

    def __init__(self, starts: np.ndarray, word: np.ndarray, weight: np.ndarray, n_words: int, k: int, decimals: int, aims: list[list[float]] | None = None) -> None:
        self.aims = aims
        self.decimals = decimals
        self.margin = max(MARGIN, 10.0 ** (1 - decimals))
        self.starts, self.word, self.weight, self.n_words, self.k = starts, word, weight, n_words, k
        self.ends, self.weights = starts.tolist(), weight.tolist()
        self.floor = np.full(len(starts) - 1, -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (len(starts) - 1)

    def add(self, docs: np.ndarray, words: np.ndarray, begin: np.ndarray, at: np.ndarray, s: np.ndarray) -> None:
        """A chunk as made by :func:`_packed`."""
        if not len(docs) or not len(self.floor):
            return
        n, k, ends, weights = len(docs), self.k, self.ends, self.weights
        most = np.maximum(np.maximum.reduceat(s, begin[:-1]), 0)
        local = np.full(self.n_words, -1)
        local[words] = np.arange(len(words))
        here = local[self.word]
        bound = np.where(here >= 0, self.weight * most[here], 0)
        asked = np.add.reduceat(here >= 0, self.starts[:-1]) > 0
        asked = np.flatnonzero(asked & (np.add.reduceat(bound, self.starts[:-1]) >= self.floor - self.margin)).tolist()
        # words of many documents as whole rows
        used = np.unique(here)
        used = used[used >= 0]
        full = used[(begin[used + 1] - begin[used]) * DENSE >= n]
        row = np.full(len(words), -1)
        row[full] = np.arange(len(full))
        whole, has = np.zeros((len(full), n)), np.zeros((len(full), n), bool)
        for r, x in enumerate(full.tolist()):
            whole[r, at[begin[x] : begin[x + 1]]] = s[begin[x] : begin[x + 1]]
            has[r, at[begin[x] : begin[x + 1]]] = True
        here, bound, row, begin = here.tolist(), bound.tolist(), row.tolist(), begin.tolist()
        total, touched, one, product = np.zeros(n), np.zeros(n, bool), np.zeros(n), np.empty(n)
        for q in asked:
            own = sorted([(bound[i], here[i], weights[i]) for i in range(ends[q], ends[q + 1]) if here[i] >= 0], reverse=True)
            rest = [0.0] * (len(own) + 1)
            for i in range(len(own) - 1, -1, -1):
                rest[i] = rest[i + 1] + own[i][0]
            floor = least = float(self.floor[q])
            seen, led, wide, i = 0, floor > -np.inf, False, 0
            # above such a floor a document is named by its sum, so places that were touched aren't kept
            blind = floor - self.margin > 0
            while i < len(own) and rest[i] >= least - self.margin:
                _, x, by = own[i]
                lo, hi = begin[x], begin[x + 1]
                if row[x] >= 0:
                    np.multiply(whole[row[x]], by, out=product)
                    total += product
                    if not blind:
                        touched |= has[row[x]]
                    wide = True
                else:
                    total[at[lo:hi]] += by * s[lo:hi]
                    if not blind:
                        touched[at[lo:hi]] = True
                seen += hi - lo
                i += 1
                if not led and i < len(own) and seen >= LEAD_DOCS * k:
                    some = total[touched]
                    if led := len(some) >= k:
                        least = max(least, float(np.partition(some, -k)[-k]))
            if blind:
                named = np.flatnonzero(total >= least - self.margin - rest[i])
                score = total[named]
                total.fill(0)
            else:
                every = np.flatnonzero(touched)
                score, named = total[every], every
                if wide:
                    total.fill(0)
                    touched.fill(False)
                else:
                    total[every], touched[every] = 0, False
            for j in range(i, len(own) + 1):
                if least > -np.inf:
                    good = score + rest[j] >= least - self.margin
                    named, score = named[good], score[good]
                if j == len(own) or not len(named):
                    break
                _, x, by = own[j]
                if row[x] >= 0:
                    score += by * whole[row[x]][named]
                    continue
                own_at, own_s = at[begin[x] : begin[x + 1]], s[begin[x] : begin[x + 1]]
                if len(named) * FEW_NAMED < len(own_at):
                    place = np.minimum(own_at.searchsorted(named), len(own_at) - 1)
                    score += np.where(own_at[place] == named, by * own_s[place], 0)
                else:
                    one[own_at] = own_s
                    score += by * one[named]
                    one[own_at] = 0
            if not len(named):
                continue
            score, name = np.round(score, self.decimals) + 0.0, docs[named]
            if self.best[q] is not None:
                name, score = np.concatenate([self.best[q][0], name]), np.concatenate([self.best[q][1], score])
            if len(score) > k:
                good = np.flatnonzero(score >= np.partition(score, -k)[-k])
                if len(good) > k:
                    good = good[np.lexsort((name[good], -score[good]))[:k]]
                name, score = name[good], score[good]
            self.best[q] = (name, score)
            if len(score) == k:
                self.floor[q] = score.min()
            if self.aims is not None:
                self._cut(q, name, score)

    def _cut(self, q: int, name: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((name, -score))
        name, low = name[order], -score[order]
        aims = self.aims[q]
        # scores within the margin count as equal: an aim's sum may have another order
        while aims and low.searchsorted(-(aims[0] + self.margin)) >= self.k:
            aims.pop(0)
        if not aims:
            self.best[q], self.floor[q] = None, np.inf
            return
        cut = int(low.searchsorted(-(aims[0] - self.margin), "right"))
        if cut < len(low):
            self.best[q], self.floor[q] = (name[: cut + 1], -low[: cut + 1]), -low[cut]

    def results(self, names: list[list]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Names, and of the results the places among the names, ranks, documents and scores. ``names``: by query, of all that ask the same."""
        step = max(1, 1_000_000 // self.k)
        found = [(x, q) for q, own in enumerate(names) if self.best[q] is not None for x in own]
        for lo in range(0, len(found), step):
            some = found[lo : lo + step]
            length = np.array([len(self.best[q][1]) for _, q in some])
            at = np.repeat(np.arange(len(some)), length)
            doc, score = (np.concatenate([self.best[q][i] for _, q in some]) for i in (0, 1))
            order = np.lexsort((doc, -score, at))
            rank = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length) + 1
            yield [x for x, _ in some], at, rank, doc[order], score[order]


def _packed(doc: np.ndarray, no: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """A chunk: its documents, its words, and per word a slice of places among the documents and of scores."""
    docs, at = np.unique(doc, return_inverse=True)
    order = np.argsort(no, kind="stable")
    words, first = np.unique(no[order], return_index=True)
    return docs.astype(np.int64), words.astype(np.int64), np.append(first, len(no)).astype(np.int64), at[order].astype(np.int32), s[order]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Packed chunks of about ``CHUNK`` rows ``(doc_id, no, s)`` that are ordered by document; a document stays whole."""
    arrays = lambda t: (t.column(c).to_numpy() for c in ("doc_id", "no", "s"))
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        doc = t.column("doc_id").to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        if cut:
            yield _packed(*arrays(t.slice(0, cut)))
            held = t.slice(cut).combine_chunks().to_batches()
            size = t.num_rows - cut
    if held:
        yield _packed(*arrays(pa.Table.from_batches(held)))


def pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows ``(doc_id, no, s)`` ordered by document to chunks, one a row of ``_CHUNK``."""
    for chunk in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in chunk], names=list(_PARTS))


def best_of(starts: np.ndarray, word: np.ndarray, weight: np.ndarray, n_words: int, k: int, decimals: int = DECIMALS):
    """mapInArrow function over ``(doc_id, no, s)`` ordered by document: ``(q, rank, doc_id, score)``, the ``k`` best of every query in the partition.

    Query q has the words ``word[starts[q] : starts[q + 1]]`` with their weights. It holds one chunk and ``k`` results a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(starts, word, weight, n_words, k, decimals)
        for chunk in _chunks(batches):
            best.add(*chunk)
        for q, at, rank, doc, score in best.results([[q] for q in range(len(starts) - 1)]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(q)[at], rank, doc, score)], names=["q", "rank", "doc_id", "score"])

    return run


def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows ``(group, qid, word, weight, judged, known)`` ordered by group, with parallel lists of words and weights, to one row of ``_GROUP`` a group."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        word, weight = (t.column(c).combine_chunks() for c in ("word", "weight"))
        length = pc.list_value_length(word).to_numpy(zero_copy_only=False)
        flat = (np.append(0, np.cumsum(length)).astype(np.int64), word.flatten().to_numpy().astype(np.int64), weight.flatten().to_numpy().astype(np.float64))
        values = [t.column("group")[0].as_py(), t.column("qid").to_pylist(), *(x.tobytes() for x in flat), t.column("judged").to_pylist(), t.column("known").to_pylist()]
        kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=["group", "qids", "starts", "word", "weight", "judged", "known"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        group = b.column("group").to_numpy()
        edges = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            if lo == hi:
                continue
            if held and held[-1].column("group")[0].as_py() != group[lo]:
                yield row(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield row(held)


def judged_scores(n_words: int):
    """mapInArrow function over rows of ``_CHUNK`` and ``_GROUP``: ``(qid, doc_id, score)`` of the judged documents that have a word of the query, not rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple] = {}
        for b in batches:
            for i in range(b.num_rows):
                group = b.column("group")[i].as_py()
                if group not in groups:
                    starts, word, weight = (np.frombuffer(b.column(c)[i].as_buffer(), x) for c, x in (("starts", np.int64), ("word", np.int64), ("weight", np.float64)))
                    lists = b.column("judged")[i].values
                    query = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    doc = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    order = np.argsort(doc, kind="stable")
                    groups[group] = (b.column("qids")[i].values, starts, word, weight, query[order], doc[order])
                qids, starts, word, weight, query, doc = groups[group]
                kinds = (np.int64, np.int64, np.int64, np.int32, np.float64)
                docs, words, begin, at, s = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(_PARTS, kinds))
                place = docs.searchsorted(doc)
                here = np.flatnonzero(docs[np.minimum(place, len(docs) - 1)] == doc)
                if not len(here):
                    continue
                q, place = query[here], place[here]
                local = np.full(n_words, -1)
                local[words] = np.arange(len(words))
                # the words of every pair
                length = starts[q + 1] - starts[q]
                first = np.cumsum(length) - length
                own = np.repeat(starts[q] - first, length) + np.arange(length.sum())
                pair = np.repeat(np.arange(len(q)), length)
                known = np.flatnonzero(local[word[own]] >= 0)
                own, pair = own[known], pair[known]
                # inside a word places ascend, so these do
                keys = np.repeat(np.arange(len(words)), np.diff(begin)) * len(docs) + at
                asked = local[word[own]] * len(docs) + place[pair]
                hit = np.minimum(keys.searchsorted(asked), len(keys) - 1)
                got = np.flatnonzero(keys[hit] == asked)
                if not len(got):
                    continue
                score = np.bincount(pair[got], weight[own[got]] * s[hit[got]], len(q))
                some = np.unique(pair[got])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[some])), pa.array(docs[place[some]]), pa.array(score[some])], names=["qid", "doc_id", "score"])

    return run


def best_of_chunks(n_words: int, k: int, decimals: int = DECIMALS, sparse: bool = False):
    """mapInArrow function over rows of ``_CHUNK`` and ``_GROUP``: ``(qid, rank, doc_id, score)``, the ``k`` best of every query of the groups. Queries with the same words are ranked once.

    ``sparse``: only the rows of judged documents, whose scores are known, and one behind them.
    """

    def group_of(b: pa.RecordBatch, i: int) -> tuple[_Best, list[list[tuple[str, list[int]]]]]:
        qids = list(zip(b.column("qids")[i].as_py(), b.column("judged")[i].as_py()))
        starts, word, weight = (np.frombuffer(b.column(c)[i].as_buffer(), x) for c, x in (("starts", np.int64), ("word", np.int64), ("weight", np.float64)))
        ends = starts.tolist()
        alike: dict[tuple[bytes, bytes], list[int]] = {}
        for q in range(len(qids)):
            alike.setdefault((word[ends[q] : ends[q + 1]].tobytes(), weight[ends[q] : ends[q + 1]].tobytes()), []).append(q)
        first = np.array([own[0] for own in alike.values()])
        length = starts[first + 1] - starts[first]
        new = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(starts[first] - new[:-1], length) + np.arange(new[-1])
        known = b.column("known")[i].as_py() if sparse else None
        aims = [sorted(x for q in own for x in known[q]) for own in alike.values()] if sparse else None
        return _Best(new, word[at], weight[at], n_words, k, decimals, aims), [[qids[q] for q in own] for own in alike.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Best, list[list[tuple[str, list[int]]]]]] = {}
        for b in batches:
            for i in range(b.num_rows):
                group = b.column("group")[i].as_py()
                if group not in held:
                    held[group] = group_of(b, i)
                kinds = (np.int64, np.int64, np.int64, np.int32, np.float64)
                docs, words, begin, at, s = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(_PARTS, kinds))
                held[group][0].add(docs, words, begin, at.astype(np.intp), s)
        for best, names in held.values():
            for qids, at, rank, doc, score in best.results(names):
                if sparse:
                    ends = np.searchsorted(at, np.arange(len(qids) + 1))
                    keep = np.zeros(len(at), bool)
                    keep[ends[1:] - 1] = True
                    for (_, own), lo, hi in zip(qids, ends[:-1].tolist(), ends[1:].tolist()):
                        if own:
                            keep[lo:hi] |= np.isin(doc[lo:hi], own)
                    at, rank, doc, score = at[keep], rank[keep], doc[keep], score[keep]
                columns = [pa.array([x for x, _ in qids], pa.string()).take(pa.array(at)), pa.array(rank), pa.array(doc), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "rank", "doc_id", "score"])

    return run
