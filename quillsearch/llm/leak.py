"""Held-out passages inside corpus documents: q-gram filtering on diagonal bands, banded alignment, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsearch.llm.neardup import mix
from quillsearch.llm.plain import folded
from quillsearch.session import stored

#: Length of a q-gram, in letters and digits.
Q = 10
#: Width of a diagonal band; bands overlap by half.
BAND = 32
#: Characters of items that are sent to the executors at a time.
ITEM_BLOCK = 8_000_000
_SEP = 0x10FFFF


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits of texts one after the other, the text of each, and whether a word begins or ends there."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), lengths + 1)[: len(chars)]
    small = chars < 128
    word = ((chars >= 97) & (chars <= 122)) | ((chars >= 48) & (chars <= 57))
    if not small.all():
        other = np.flatnonzero(~small)
        word[other] = [chr(c).isalnum() for c in chars[other]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    return chars[word], of[word], begins[word], ends[word]


def _grams(chars: np.ndarray, of: np.ndarray, length: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` characters that lie in one text, and where they begin."""
    n = len(chars) - length + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    c = chars.astype(np.uint64)
    for i in range(length):
        h = h * np.uint64(0x100000001B3) + c[i : i + n]
    at = np.flatnonzero(of[:n] == of[length - 1 :])
    return mix(h[at]), at


@dataclass(frozen=True)
class Items:
    """Q-gram index of the passages and their distinct word sequences."""

    ids: np.ndarray
    text: list[np.ndarray]
    sequences: list[list[str]]
    need: np.ndarray
    least: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index_items(ids: list[int], texts: list[str], words: int, share: Fraction) -> Items:
    """Index of the items; those without a whole sequence are left out.

    ``need`` is the number of an item's sequences that make a leak; all edits that leave so many
    are in the budget. ``bound`` is how many of its q-grams any such edits leave at least: a
    sequence of L characters holds L - Q + 1, and a q-gram lies in at most ``words`` sequences.
    Items without a bound can leak by sequences shorter than a q-gram; ``short`` has those by their
    lengths: hashes in order, and the item of each.
    """
    kept, streams, sequences, least, need, bound = [], [], [], [], [], []
    for i, t in zip(ids, texts):
        t = folded(t)
        tokens = ["".join(c for c in w if c.isalnum()) for w in t.split()]
        tokens = [w for w in tokens if w]
        if len(tokens) < words:
            continue
        own = list(dict.fromkeys("".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)))
        kept.append(i)
        sequences.append(own)
        size = sorted(map(len, own))
        least.append(size[0])
        need.append(max(1, -(-len(own) * share.numerator // share.denominator)))
        bound.append(-(-sum(max(0, n - Q + 1) for n in size[: need[-1]]) // words))
        streams.append("".join(tokens))
    chars, of, _, _ = _stream(streams) if streams else (np.empty(0, np.uint32), np.empty(0, np.int64), None, None)
    h, at = _grams(chars, of)
    start = np.searchsorted(of, np.arange(len(kept)))
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[(grams >> np.uint64(42)).astype(np.int64)] = True
    item = of[at][order]
    small: dict[int, list[tuple[str, int]]] = {}
    for i in np.flatnonzero(np.array(bound) == 0).tolist():
        for q in sequences[i]:
            if len(q) < Q:
                small.setdefault(len(q), []).append((q, i))
    short = {}
    for length, pairs in small.items():
        letters = np.frombuffer("".join(q for q, _ in pairs).encode("utf-32-le"), np.uint32)
        hashes, _ = _grams(letters, np.repeat(np.arange(len(pairs)), length), length)
        rank = np.argsort(hashes, kind="stable")
        short[length] = hashes[rank], np.array([i for _, i in pairs])[rank]
    return Items(
        np.array(kept, np.int64),
        [chars[s:e] for s, e in zip(start, np.append(start[1:], len(chars)))],
        sequences,
        np.array(need, np.int64),
        np.array(least, np.int64),
        np.array(bound, np.int64),
        grams,
        np.append(first, len(h)),
        item,
        at[order] - start[item],
        seen,
        short,
    )


def regions(items: Items, chars: np.ndarray, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands that may hold a sequence of a leaked item: ``(text, item, diagonal)``.

    A text that shares fewer distinct q-grams with an item than the item's ``bound`` holds too
    few of its sequences. Of the others, a sequence of L characters shares L - Q + 1 q-grams
    with its copy on one diagonal; bands with fewer than that for the item's shortest
    sequence hold none.
    """
    none = np.empty(0, np.int64)
    h, at = _grams(chars, of)
    maybe = items.seen[(h >> np.uint64(42)).astype(np.int64)]
    h, at = h[maybe], at[maybe]
    if not len(items.grams) or not len(h):
        return none, none, none
    slot = np.minimum(np.searchsorted(items.grams, h), len(items.grams) - 1)
    hit = items.grams[slot] == h
    slot, at = slot[hit], at[hit]
    n = items.first[slot + 1] - items.first[slot]
    at = np.repeat(at, n)
    entry = np.repeat(items.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, text = items.item[entry], of[at]
    diagonal = (at - starts[text]) - items.at[entry]
    # distinct q-grams of each item in each text
    pair = text * len(items.ids) + item
    place = np.unique(pair * (1 << 24) + items.at[entry]) >> 24
    many, count = np.unique(place, return_counts=True)
    many = many[count >= np.maximum(1, items.bound[many % len(items.ids)])]
    ok = many[np.minimum(np.searchsorted(many, pair), max(0, len(many) - 1))] == pair if len(many) else np.zeros(len(pair), bool)
    text, item, diagonal = text[ok], item[ok], diagonal[ok]
    half = BAND // 2
    low = diagonal // half
    shift = np.int64(1) << 31
    key = np.concatenate([low, low - 1]) + shift
    two = np.concatenate([text, text]) * len(items.ids) + np.concatenate([item, item])
    order = np.lexsort((key, two))
    key, two = key[order], two[order]
    if not len(key):
        return none, none, none
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (two[1:] != two[:-1])]))
    count = np.diff(np.append(new, len(key)))
    who = two[new] % len(items.ids)
    ok = count >= np.maximum(1, items.least[who] - Q + 1)
    new = new[ok]
    return two[new] // len(items.ids), two[new] % len(items.ids), (key[new] - shift) * half


def align(items: Items, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Best local alignment score of each region inside its band: 1 for a match, -1 for an edit.

    All regions advance in lockstep, one item character per step. A row's gaps are a running
    maximum along the band. An unedited sequence of L characters scores at least L.
    """
    length = np.array([len(items.text[i]) for i in item])
    most = int(length.max())
    passage = np.zeros((len(item), most), np.uint32)
    for r, i in enumerate(item):
        passage[r, : length[r]] = items.text[i]
    width = BAND + 1
    lane = np.arange(width)
    score = np.zeros((len(item), width), np.int32)
    best = np.zeros(len(item), np.int32)
    base, stop = starts[text], stops[text]
    for i in range(most):
        live = i < length
        where = base[:, None] + diagonal[:, None] + lane[None, :] + i
        inside = (where >= base[:, None]) & (where < stop[:, None]) & live[:, None]
        here = chars[np.clip(where, 0, len(chars) - 1)]
        same = inside & (here == passage[:, i][:, None])
        step = np.where(same, score + 1, score - 1)
        step[:, :-1] = np.maximum(step[:, :-1], score[:, 1:] - 1)
        step = np.maximum(step, 0)
        score = (np.maximum.accumulate(step + lane, axis=1) - lane).astype(np.int32)
        score[~inside] = 0
        best = np.maximum(best, score.max(axis=1))
    return best


def short_hits(items: Items, chars: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
    """``(text, item)`` where a text has one of the ``short`` sequences of an item without a bound."""
    found = set()
    for length, (hashes, item) in items.short.items():
        h, at = _grams(chars, of, length)
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        n = hi - lo
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found |= set(zip(np.repeat(of[at], n).tolist(), item[entry].tolist()))
    return found


def find_leaks(items: Items):
    """mapInArrow function: ``(id, text)`` to ``(doc_id, item_id, shared, sequences)`` for every leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                rows = [(i, folded(t)) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) if i is not None and t]
                if not rows or not len(items.ids):
                    continue
                chars, of, begins, ends = _stream([t for _, t in rows])
                bounds = np.searchsorted(of, np.arange(len(rows) + 1))
                starts, stops = bounds[:-1], bounds[1:]
                text, item, diagonal = regions(items, chars, of, starts)
                pairs = set()
                for at in range(0, len(text), 2000):
                    own = slice(at, at + 2000)
                    score = align(items, chars, starts, stops, text[own], item[own], diagonal[own])
                    ok = score >= items.least[item[own]]
                    pairs |= set(zip(text[own][ok].tolist(), item[own][ok].tolist()))
                pairs |= short_hits(items, chars, of)
                out = []
                for t, i in sorted(pairs):
                    s, e = int(starts[t]), int(stops[t])
                    line = chars[s:e].tobytes().decode("utf-32-le")
                    shared = sum(_has(line, q, begins[s:e], ends[s:e]) for q in items.sequences[i])
                    if shared >= items.need[i]:
                        out.append((rows[t][0], int(items.ids[i]), shared, len(items.sequences[i])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "shared", "sequences"]
                    )

    return run


def _has(line: str, sequence: str, begins: np.ndarray, ends: np.ndarray) -> bool:
    """Whether ``sequence`` occurs in ``line`` from the beginning of a word to the end of one."""
    at = line.find(sequence)
    while at >= 0:
        if begins[at] and ends[at + len(sequence) - 1]:
            return True
        at = line.find(sequence, at + 1)
    return False


def leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int, share: Fraction
) -> DataFrame:
    """Documents with at least ``share`` of a held-out passage: ``(doc_id, item_id, shared, sequences)``.

    ``shared`` is the number of the passage's distinct sequences of ``words`` words that occur in the
    document, ``sequences`` how many it has. Letters and digits are compared without
    what stands between them, so case, punctuation, layout, hyphenation at line ends,
    markup and encoding don't matter.

    The passages, a fixed set, are sent to the executors in blocks of about ``ITEM_BLOCK``
    characters; one block is in memory at a time, and the results of several are written one after
    the other. Documents are never shuffled.

    Defined cases: null ids and null or empty texts have no leak; a passage of fewer than ``words``
    words has no sequence and can't leak; a document or passage given twice counts once; empty
    tables give no rows.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    held = (
        items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
        .where("id is not null and text is not null")
        .dropDuplicates(["id"])
    )
    size = held.agg(F.sum(F.length("text")).alias("n")).head()["n"] or 0
    blocks = max(1, -(-size // ITEM_BLOCK))
    found = None
    for i in range(blocks):
        rows = sorted(tuple(r) for r in held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect())
        part = index_items([r[0] for r in rows], [r[1] for r in rows], words, share)
        got = base.mapInArrow(find_leaks(part), "doc_id long, item_id long, shared long, sequences long")
        got = got if blocks == 1 else stored(got, "leaks")
        found = got if found is None else found.unionByName(got)
    return found.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("sequences").alias("sequences"))
