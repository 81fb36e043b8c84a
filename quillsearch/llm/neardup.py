"""Near-duplicate texts: one-permutation signatures, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsearch.llm.graph import components
from quillsearch.operators.bloom import in_passes
from quillsearch.session import stored

_WORD = re.compile("[a-z0-9]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bins of the sketch that screens candidate edges, and bits of each; one 64-bit word holds one bit of 64 bins.
SKETCH_BINS, SKETCH_BITS = 128, 4
SKETCH = [f"s{i}" for i in range(SKETCH_BINS // 64 * SKETCH_BITS)]
#: Sequences below which a text's sketch says nothing: its bins are copies of a few values.
FEW = 32
#: A class of exact copies with more than this share of all documents meets its result by a broadcast; at most 1 / HOT_SHARE classes can.
HOT_SHARE = 1e-4
#: Texts of one family are compared in blocks of about this many, each pair of blocks by itself.
BLOCK = 256
#: Groups of at most this many texts are compared together in one sparse product, larger ones each in a dense one.
SMALL, POOL = 48, 4_000


@dataclass(frozen=True)
class Likeness:
    """What makes two texts near-duplicates, and how candidates are sought.

    ``words``: length of a word sequence; ``least``: smallest Jaccard similarity of the sets
    of sequences. ``bands`` x ``rows`` signature bins: a pair at similarity s shares a
    bucket with probability 1 - (1 - s^rows)^bands, which is 0.998 at s = 0.5 for the
    default and nearer to 1 above. ``slack``: bins of 128 in which the sketches of a text and its bucket's
    centre may differ; at s = 0.5 the mean is 60 and 84 is more than four deviations above.
    """

    words: int = 5
    least: Fraction = Fraction(4, 5)
    bands: int = 48
    rows: int = 3
    slack: int = 84


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word sequences of texts."""

    def __init__(self, words: int) -> None:
        self.k = words
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Distinct sequences of the whole text, as sorted 64-bit hashes; empty below ``k`` words."""
        found = _WORD.findall(text.lower())
        n = len(found) - self.k + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        codes = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            codes.append(h)
        c = np.array(codes, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(self.k):
            total += mix(c[i : i + n] + _ODD[i]) * _ODD[i]
        return np.unique(mix(total))


def _donors(bins: int, attempt: int) -> np.ndarray:
    """Bin from which an empty bin copies at an attempt: a universal hash of (bin, attempt), the same for all texts."""
    x = np.arange(bins, dtype=np.uint64) + np.uint64(attempt) * np.uint64(0x1000003)
    return ((mix(x * _ODD[3] + _ODD[7]) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures with optimal densification, one row per non-empty set.

    One hash places a sequence in a bin and ranks it there; a bin keeps its least. An empty
    bin copies a non-empty one chosen by hashing (bin, attempt), so two texts agree in a
    bin with the probability of their similarity.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(len(sets) * bins, top, np.uint64)
    np.minimum.at(sig, rows * bins + at, mix(h ^ _ODD[11]) >> np.uint64(1))
    sig = sig.reshape(len(sets), bins)
    r, b = np.nonzero(sig == top)
    full = sig.copy()
    attempt = 1
    while len(r):
        got = sig[r, _donors(bins, attempt)[b]]
        ok = got != top
        full[r[ok], b[ok]] = got[ok]
        r, b = r[~ok], b[~ok]
        attempt += 1
    return full


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket per band of ``rows`` bins, different for every band."""
    n, bins = sig.shape
    parts = sig.reshape(n, bins // rows, rows)
    total = np.broadcast_to(mix(np.arange(bins // rows, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(rows):
        total += mix(parts[:, :, i] + _ODD[i]) * _ODD[i]
    return mix(total).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """The last ``SKETCH_BITS`` bits of ``SKETCH_BINS`` bins of every row, as ``SKETCH`` words: equal bins estimate the similarity."""
    bins = mix(sig[:, np.arange(SKETCH_BINS) * sig.shape[1] // SKETCH_BINS])
    planes = [(bins >> np.uint64(i)) & np.uint64(1) for i in range(SKETCH_BITS)]
    words = np.concatenate(planes, axis=1).reshape(len(sig), len(SKETCH), 64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(words, axis=2).view(np.int64)


def _apart(one: str, two: str) -> Column:
    """Bins in which two sketches differ, of columns named by ``SKETCH`` with a letter before."""
    wide = len(SKETCH) // SKETCH_BITS
    total = F.lit(0)
    for w in range(wide):
        differ = F.lit(0).cast("long")
        for c in SKETCH[w::wide]:
            differ = differ.bitwiseOR(F.col(one + c).bitwiseXOR(F.col(two + c)))
        total = total + F.bit_count(differ)
    return total


def _node(sequences: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(sequences.tobytes()) - 2**63


SIGNED = f"id long, node long, few boolean, {', '.join(c + ' long' for c in SKETCH)}, bands array<long>"


def sign(like: Likeness):
    """mapInArrow function: ``(id, text)`` to rows of ``SIGNED``.

    ``node`` is a hash of the whole set of sequences, so exact copies are one node. Its first row
    in a partition has the buckets, further ones have none, so copies don't multiply
    what is shuffled. Texts that are null or too short for one sequence give no row.
    """
    bins = like.bands * like.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(like.words)
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets, ids = [], []
                for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                    if i is not None and t is not None and len(s := shingles(t)):
                        sets.append(s)
                        ids.append(i)
                if not ids:
                    continue
                sig = signatures(sets, bins)
                sketch = sketches(sig)
                keys = band_keys(sig, like.rows)
                nodes = [_node(s) for s in sets]
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.zeros(len(nodes), bool)
                for i, x in enumerate(nodes):
                    fresh[i] = x not in seen
                    seen.add(x)
                ends = np.concatenate([[0], np.cumsum(fresh * like.bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array([len(s) < FEW for s in sets]),
                        *(pa.array(sketch[:, i]) for i in range(len(SKETCH))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[fresh].ravel())),
                    ],
                    names=["id", "node", "few", *SKETCH, "bands"],
                )

    return run


def star_edges(signed: DataFrame, like: Likeness) -> DataFrame:
    """Star edges ``(node, centre)``: in every bucket each node meets only the bucket's centre, its least node.

    A text is in ``bands`` buckets, so it has at most that many edges, however large the
    buckets are. Centres are a partial aggregate, and only texts of buckets with two nodes are
    shuffled to meet them. A sketch screens out chance meetings, but for texts of fewer
    than ``FEW`` sequences, which are all kept.
    """
    placed = signed.select("node", F.explode("bands").alias("bucket"))
    pair = placed.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("most"))
    centres = stored(pair.where("centre < most").select("bucket", "centre"), "centres")
    meet = lambda own, screened: screened(placed).join(own, "bucket").where("node <> centre").select("node", "centre").distinct()
    # a pair that met in buckets of several passes is there once
    met = stored(in_passes(centres, "bucket", "bucket", "met-part", meet).distinct(), "met")
    ends = stored(met.select("node").unionByName(met.select(F.col("centre").alias("node"))).distinct(), "ends")
    bits = in_passes(ends, "node", "node", "bits", lambda _, screened: screened(signed).select("node", "few", *SKETCH).distinct())
    one = bits.toDF("node", "few_a", *("a" + c for c in SKETCH))
    two = bits.toDF("centre", "few_b", *("b" + c for c in SKETCH))
    near = met.join(one, "node").join(two, "centre").where(F.col("few_a") | F.col("few_b") | (_apart("a", "b") <= like.slack))
    return near.select("node", "centre")


def blocks_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, block)`` of every node with an edge, and the pairs ``(i, j)`` of blocks that have to be compared.

    A node's home is the least of its centres, so a family gathers at one of them, and a
    chain of texts that each resemble only the next ones falls into many homes. Homes are cut
    into blocks of about ``BLOCK`` nodes. Two nodes that met in a bucket have its
    centre in common; so blocks are compared if members of both have one, and the number of
    comparisons follows the number of meetings, not the square of a component.
    """
    of = edges.unionByName(edges.select(F.col("centre").alias("node"), "centre")).distinct()
    of = stored(of, "stars")
    homes = of.groupBy("node").agg(F.min("centre").alias("home"))
    size = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.col("n"))
    blocks = stored(homes.join(size, "home").select("node", F.xxhash64("home", part).alias("block")), "blocks")
    at = of.join(blocks, "node").select("centre", "block").distinct()
    pairs = at.withColumnRenamed("block", "i").join(at.withColumnRenamed("block", "j"), "centre").where("i <= j")
    return blocks, pairs.select("i", "j").distinct()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the columns that at least two sets have."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    at = np.full(len(values), -1)
    at[shared] = np.arange(len(shared))
    column = at[column]
    rows, column = rows[column >= 0], column[column >= 0]
    total = np.zeros((n, n), np.float32)
    for lo in range(0, len(shared), 8192):
        own = (column >= lo) & (column < lo + 8192)
        part = np.zeros((n, min(8192, len(shared) - lo)), np.float32)
        part[rows[own], column[own] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _shared_few(sets: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(p, q, size)`` of the non-empty intersections of sets of the same group, p < q, for many small groups at once."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.lexsort((values, group[rows]))
    values, rows = values[order], rows[order]
    own = group[rows]
    run = np.cumsum(np.concatenate([[True], (values[1:] != values[:-1]) | (own[1:] != own[:-1])]))
    found, at, apart = [], np.arange(len(rows)), 1
    while len(at):
        at = at[at + apart < len(rows)]
        at = at[run[at] == run[at + apart]]
        found.append(rows[at] * len(sets) + rows[at + apart])
        apart += 1
    pair, size = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
    return pair // len(sets), pair % len(sets), size


def verify_blocks(like: Likeness):
    """mapInArrow function over rows ``(i, j, block, node, text)`` sorted by (i, j): exact pairs.

    In a block with itself all pairs are compared, in a pair of blocks those across. It holds
    one pair of blocks, or small ones of together ``POOL`` texts.
    """

    def pairs(groups: list[tuple[bool, dict[int, tuple[int, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
        node = np.array([x for _, g in groups for x in g], np.int64)
        block = np.array([b for _, g in groups for b, _ in g.values()], np.int64)
        sets = [s for _, g in groups for _, s in g.values()]
        group = np.repeat(np.arange(len(groups)), [len(g) for _, g in groups])
        if len(groups) == 1 and len(sets) > SMALL:
            p, q = np.nonzero(np.triu(together := _shared(sets), 1))
            both = together[p, q]
        else:
            p, q, both = _shared_few(sets, group)
        size = np.array([len(s) for s in sets])
        either = size[p] + size[q] - both
        cross = np.array([c for c, _ in groups], bool)[group[p]]
        ok = (both * like.least.denominator >= either * like.least.numerator) & (~cross | (block[p] != block[q]))
        if ok.any():
            a, b = node[p[ok]], node[q[ok]]
            columns = [np.minimum(a, b), np.maximum(a, b), both[ok], either[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "both", "either"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(like.words)
        pool: list[tuple[bool, dict[int, tuple[int, np.ndarray]]]] = []
        last, held, n = None, {}, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal pool, n
            if len(held) > SMALL:
                yield from pairs([(last[0] != last[1], held)])
            elif len(held) > 1:
                pool.append((last[0] != last[1], held))
                n += len(held)
            if n >= POOL:
                yield from pairs(pool)
                pool, n = [], 0

        for b in batches:
            for i, j, block, node, text in zip(*(c.to_pylist() for c in b.columns)):
                if last != (i, j):
                    yield from close()
                    last, held = (i, j), {}
                if node not in held:
                    s = shingles(text)
                    # an id that came with several texts brings them all
                    if _node(s) == node:
                        held[node] = (block, s)
        yield from close()
        if pool:
            yield from pairs(pool)

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """``members (id, node)``: every document with a sequence and its class of exact copies; ``pairs (a, b, both, either)``: nodes that are near-duplicates."""

    members: DataFrame
    pairs: DataFrame


def near_duplicates(docs: DataFrame, doc_id: str, text: str, like: Likeness) -> NearDuplicates:
    """All pairs of different texts whose sets of word sequences reach ``like.least``.

    Candidates come from star edges: texts that share a bucket share its centre. Families
    around the centres are cut into blocks, and only pairs of blocks with a centre in common
    are compared, exactly, over the whole texts. Only texts with an edge are moved, one of each
    class of exact copies.

    Defined cases: null ids, null texts and texts shorter than one sequence take part in
    nothing; rows that repeat an id count once; exact copies are one node; an empty table
    gives empty results. Only the two named columns are read.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = stored(base.mapInArrow(sign(like), SIGNED), "signed")
    members = signed.select("id", "node").distinct()
    blocks, pairs = blocks_of(star_edges(signed, like))
    speaker = signed.groupBy("node").agg(F.min("id").alias("id"))
    chosen = stored(speaker.join(blocks, "node"), "speakers")
    spoken = lambda own, screened: own.join(screened(base.where("text is not null")).dropDuplicates(["id", "text"]), "id")
    rows = in_passes(chosen, "id", "id", "texts", spoken).select("block", "node", "text")
    pairs = stored(pairs, "pairs")
    sent = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.where("i < j").select("i", "j", F.col("j").alias("block")))
    spread = sent.join(rows, "block").select("i", "j", "block", "node", "text")
    spread = spread.repartition("i", "j").sortWithinPartitions("i", "j")
    return NearDuplicates(members, spread.mapInArrow(verify_blocks(like), "a long, b long, both long, either long"))


def document_pairs(found: NearDuplicates) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b for all near-duplicate documents, exact copies included."""
    m = found.members
    one, two = m.toDF("x", "a"), m.toDF("y", "b")
    across = found.pairs.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    within = m.toDF("x", "node").join(m.toDF("y", "node"), "node").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(found: NearDuplicates) -> DataFrame:
    """``(id, group_id, n_links)``: every document with a sequence, the least id of its group, and the number of other texts it is linked to."""
    pairs = stored(found.pairs, "pairs")
    of = components(pairs.select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    links = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = found.members.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(of, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stored(nodes, "nodes")
    named = nodes.groupBy("component").agg(F.min("least").alias("group_id"))
    result = nodes.join(named, "component").select("node", "copies", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    total = nodes.agg(F.sum("copies")).head()[0] or 0
    hot = F.broadcast(result.where(F.col("copies") > F.lit(HOT_SHARE * total)).drop("copies"))
    rest = result.where(F.col("copies") <= F.lit(HOT_SHARE * total)).drop("copies")
    few = found.members.join(hot, "node")
    others = found.members.join(hot.select("node"), "node", "left_anti").join(rest, "node")
    return few.unionByName(others).select("id", "group_id", "n_links")
