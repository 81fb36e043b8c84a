"""The N best items of every group by merging sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsearch.session import input_partitions, parallelism

#: Runs of a group that are merged at a time. More runs take more passes, each with so many times fewer.
FAN_IN = 256


def _changes(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before in any column; True for the first row."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
        for c in columns:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _one_chunk(t: pa.Table) -> pa.Table:
    return t.combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def cut_run(t: pa.Table, n: int) -> tuple[np.ndarray, int]:
    """Rows to keep of a chunk sorted by (g, score descending, item): the first ``n`` distinct items of each group.

    Returns the kept positions and the position where the last group begins.
    """
    new = _changes(_column(t, "g"))
    group = np.cumsum(new) - 1
    item = _column(t, "item").to_numpy(zero_copy_only=False)
    order = np.lexsort((np.arange(len(item)), item, group))
    again = np.zeros(len(item), bool)
    again[order[1:]] = (group[order[1:]] == group[order[:-1]]) & (item[order[1:]] == item[order[:-1]])
    fresh = ~again
    seen = np.cumsum(fresh)
    start = np.flatnonzero(new)
    rank = seen - (seen[start] - fresh[start])[group]
    return np.flatnonzero(fresh & (rank <= n)), int(start[-1])


def cut_runs(n: int):
    """mapInArrow function: cuts one sorted run, whatever its size, holding one batch and at most ``n`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = _one_chunk(pa.concat_tables([held, t])) if held is not None else t
            keep, last = cut_run(t, n)
            kept = t.take(pa.array(keep))
            cut = int(np.searchsorted(keep, last))
            yield from kept.slice(0, cut).to_batches()
            held = kept.slice(cut)
        if held is not None:
            yield from held.to_batches()

    return run


def merge_runs(score: np.ndarray, item: np.ndarray, group: np.ndarray, new_run: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Loser-tree merge of the runs of many groups in lockstep.

    Rows are sorted by (group, run, score descending, item); ``new_run`` marks where a
    run of a group begins. Each group has its own loser tree over its runs; one numpy
    step pops the winner of every unfinished group and replays its path. A group is left
    as soon as it has ``n`` distinct items, so the rest of its runs isn't visited.
    Returns the positions of the winners and their ranks, from 1.
    """
    size = len(score)
    starts = np.flatnonzero(new_run)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.append(starts[1:], size)
    of = group[starts]
    runs = np.bincount(of, minlength=int(group[-1]) + 1)
    first = np.cumsum(runs) - runs
    width = np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(runs, 1))).astype(int))
    # position ``size`` is an empty run, which loses against any row
    s = np.append(score, -np.inf)
    d = np.append(item, np.iinfo(np.int64).max)
    stop = np.repeat(ends, ends - starts)
    stop = np.append(stop, size)
    out_at, out_rank = [], []

    def beats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b == size) | ((a != size) & ((s[a] > s[b]) | ((s[a] == s[b]) & (d[a] <= d[b]))))

    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        g = len(own)
        leaf = first[own][:, None] + np.arange(w)[None, :]
        leaf = np.where(np.arange(w)[None, :] < runs[own][:, None], leaf, -1)
        heads = np.where(leaf >= 0, starts[leaf], size)
        run_of = np.full(size + 1, -1)
        flat = leaf[leaf >= 0]
        lengths = ends[flat] - starts[flat]
        slot = np.tile(np.arange(w), (g, 1))[leaf >= 0]
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        run_of[np.repeat(starts[flat], lengths) + offset] = np.repeat(slot, lengths)
        losers = np.full((g, max(w, 1)), size)
        level = heads
        while level.shape[1] > 1:
            a, b = level[:, ::2], level[:, 1::2]
            won = beats(a, b)
            half = level.shape[1] // 2
            losers[:, half : 2 * half] = np.where(won, b, a)
            level = np.where(won, a, b)
        winner = level[:, 0]
        taken = np.full((g, n), -1, np.int64)
        filled = np.zeros((g, n), bool)
        count = np.zeros(g, np.int64)
        live = np.flatnonzero(winner != size)
        while len(live):
            at = winner[live]
            known = (filled[live] & (taken[live] == d[at][:, None])).any(axis=1)
            fresh = ~known
            rows, pos = live[fresh], at[fresh]
            taken[rows, count[rows]] = d[pos]
            filled[rows, count[rows]] = True
            count[rows] += 1
            out_at.append(pos)
            out_rank.append(count[rows].copy())
            nxt = np.where(at + 1 < stop[at], at + 1, size)
            node = (run_of[at] + w) // 2
            cur = nxt
            while w > 1 and node[0] >= 1:
                other = losers[live, node]
                lost = ~beats(cur, other)
                losers[live, node] = np.where(lost, cur, other)
                cur = np.where(lost, other, cur)
                node = node // 2
                if not node.any():
                    break
            winner[live] = cur
            live = live[(cur != size) & (count[live] < n)]
    if not out_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_at), np.concatenate(out_rank)


def merge_bucket(n: int):
    """mapInArrow function over a bucket sorted by (g, wave, run, score descending, item).

    Merges the runs of every (g, wave) into one, ``wave`` by number. What it holds is a batch and one
    such set of runs, at most ``n`` rows from each of ``FAN_IN`` runs.
    """

    def starts_of(t: pa.Table) -> np.ndarray:
        return _changes(_column(t, "g"), _column(t, "wave"))

    def key(t: pa.Table, row: int) -> tuple:
        return t.column("g")[row].as_py(), t.column("wave")[row].as_py()

    def merged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = _one_chunk(t)
        new = starts_of(t)
        run = _changes(_column(t, "g"), _column(t, "wave"), _column(t, "run"))
        at, rank = merge_runs(
            _column(t, "score").to_numpy(zero_copy_only=False),
            _column(t, "item").to_numpy(zero_copy_only=False),
            np.cumsum(new) - 1,
            run,
            n,
        )
        # in the order of their ranks, so that the result is a run itself
        order = np.lexsort((rank, np.cumsum(new)[at]))
        got = t.select(["g", "item", "score", "wave"]).take(pa.array(at[order])).rename_columns(["g", "item", "score", "run"])
        yield from got.append_column("rank", pa.array(rank[order], pa.int64())).combine_chunks().to_batches()

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            last = int(np.flatnonzero(starts_of(t))[-1])
            same = bool(held) and key(held[-1], -1) == key(t, 0)
            if last == 0 and (same or not held):
                held.append(t)
                continue
            yield from merged(pa.concat_tables([*held, t.slice(0, last)]))
            held = [t.slice(last)]
        if held:
            yield from merged(pa.concat_tables(held))

    return bucket


def top_n(df: DataFrame, group: Column, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best distinct items of every group: ``(g, item, score, rank)``.

    Order: ``score`` descending, then ``item`` ascending, so it is the same on every run.

    1. Every input partition is sorted without a shuffle into one run and cut to the first
       ``n`` distinct items of each group; a group of a third of all rows leaves ``n`` rows a run.
    2. The cut runs are stored bucketed by group in a shuffle, each bucket ordered by group and run.
    3. A loser tree per group merges its runs and goes on to the next group after ``n`` items. What it leaves
       of a run is less than ``n`` rows, for runs are stored cut.
    4. Beyond ``FAN_IN`` runs, passes over buckets of (group, ``FAN_IN`` runs) come before, so the runs of a
       hot group are spread over tasks and no task holds more than ``FAN_IN`` x ``n`` rows of it.

    Defined cases: rows with a null group or item and scores that are null, NaN or infinite
    don't take part; an item present more than once counts once, with its highest
    score; a group with fewer items gives all of them; 0.0 and -0.0 tie; an empty
    table gives no rows. Only the named columns are read.
    """
    rows = df.select(
        group.cast("string").alias("g"), F.col(item).cast("long").alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score")
    ).where("g is not null and item is not null and score is not null and not isnan(score) and abs(score) < double('Infinity')")
    rows = rows.withColumn("run", F.spark_partition_id())
    order = [F.desc("score"), "item"]
    left = input_partitions(rows)
    # a bucket for every few input partitions, which are larger than the runs cut from them
    buckets = max(parallelism(df.sparkSession), left // 4)
    runs = rows.sortWithinPartitions("g", *order).mapInArrow(cut_runs(n), "g string, item long, score double, run int")
    while True:
        left = -(-left // FAN_IN)
        waves = runs.withColumn("wave", F.floor(F.col("run") / FAN_IN).cast("int") if left > 1 else F.lit(0))
        keys = ["g", "wave"] if left > 1 else ["g"]
        bucketed = waves.repartition(buckets, *keys).sortWithinPartitions("g", "wave", "run", *order)
        runs = bucketed.mapInArrow(merge_bucket(n), "g string, item long, score double, run int, rank long")
        if left <= 1:
            return runs.select("g", "item", "score", "rank")
        runs = runs.drop("rank")
