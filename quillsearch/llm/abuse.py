"""Scores of documents for abusive, hateful or sexual content by a convolutional classifier trained in numpy."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsearch.llm.plain import folded
from quillsearch.session import stored

#: Labelled documents used for fitting, at most, of each class.
FIT_UNFIT, FIT_CLEAN = 3_000, 6_000
#: Rows of the hashed embedding table, its width, filter widths and filters of each.
SLOTS, DIM, WIDTHS, FILTERS = 1 << 16, 24, (1, 2, 3, 4), 24
EPOCHS, BATCH, SEED = 9, 64, 11
#: Labelled documents a language needs for a threshold of its own, and unfit ones before its doubtful labels are dropped as plainly wrong.
LEAST_LABELS, SURE_LABELS = 150, 300
#: Score beyond which a document counts as unfit when their share is taken.
SURE = 0.9

# fixed values: characters written for letters
_LEET = str.maketrans("013457@$", "oieastas")
_SPELT = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$][ _.\-*]){3,}[a-z0-9@$](?![a-z0-9])")
_TOKEN = re.compile(r"[a-z0-9@$*]+(?:[!'_\-][a-z0-9@$*]+)*")
_LONG = re.compile(r"([a-z*])\1{2,}")
_PLAIN = re.compile(r"[a-z]+")
_VOWELS = re.compile(r"[aeiou]")


def tokens(text: str) -> list[str]:
    """Words of the whole text, with spelt-out, masked, stretched and digit-for-letter spellings undone where that is certain."""
    text = _SPELT.sub(lambda m: re.sub(r"[ _.\-*]", "", m.group()), folded(text))
    out = []
    for w in _TOKEN.findall(text):
        if not _PLAIN.fullmatch(w):
            if not any(c.isalpha() for c in w) and not ("@" in w or "$" in w):
                w = "0" if w.strip("*_-'") else "*"
            else:
                w = re.sub(r"[!'_\-]", "", w.replace("!", "i")).translate(_LEET)
        if len(w) > 3:
            w = _LONG.sub(r"\1", w)
        out.append(w)
    return out


def pieces(word: str) -> list[int]:
    """Rows of the embedding table for a word: itself, its consonants, and its letter trigrams."""
    framed = f"<{word}>"
    names = [word, "#" + _VOWELS.sub("", word)] + [framed[i : i + 3] for i in range(len(framed) - 2)]
    return [xxhash.xxh32_intdigest(n) & (SLOTS - 1) for n in dict.fromkeys(names)]


@dataclass
class Texts:
    """Documents as rows of word numbers, one after the other, and the pieces of each distinct word."""

    words: np.ndarray
    starts: np.ndarray
    piece: np.ndarray
    piece_starts: np.ndarray

    @staticmethod
    def of(texts: list[list[str]], known: dict[str, list[int]]) -> Texts:
        """Padding words between documents keep filters inside one document."""
        number: dict[str, int] = {"": 0}
        flat, starts = [], []
        pad = [0] * (max(WIDTHS) - 1)
        for t in texts:
            starts.append(len(flat))
            flat += [number.setdefault(w, len(number)) for w in t] or [0]
            flat += pad
        piece, piece_starts = [0], [0]
        for w in list(number)[1:]:
            p = known.get(w)
            if p is None:
                if len(known) > 300_000:
                    known.clear()
                p = known[w] = pieces(w)
            piece_starts.append(len(piece))
            piece += p
        return Texts(np.array(flat), np.array(starts), np.array(piece), np.array(piece_starts))


@dataclass
class Net:
    """Hashed embeddings, convolutions of several widths, maximum over the document, logistic output."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Net:
        n = len(WIDTHS) * FILTERS
        return Net(
            (rng.standard_normal((SLOTS, DIM)) * 0.25).astype(np.float32),
            [(rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS],
            np.zeros(n, np.float32),
            (rng.standard_normal(n) * 0.1).astype(np.float32),
            -1.5,
        )

    def embed(self, t: Texts) -> np.ndarray:
        n = np.diff(np.append(t.piece_starts, len(t.piece)))
        e = np.add.reduceat(self.table[t.piece], t.piece_starts, axis=0) / np.sqrt(n)[:, None]
        e[0] = 0
        return e

    def pooled(self, t: Texts, e: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of every filter over every document, and the activations per width."""
        parts, acts = [], []
        for w, f in zip(WIDTHS, self.filters):
            n = len(t.words) - w + 1
            a = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                a += (e @ f[j])[t.words[j : j + n]]
            acts.append(a)
            parts.append(np.maximum.reduceat(a, np.minimum(t.starts, n - 1), axis=0))
        return np.concatenate(parts, axis=1), acts

    def score(self, t: Texts) -> np.ndarray:
        h = np.maximum(self.pooled(t, self.embed(t))[0] + self.bias, 0)
        return 1 / (1 + np.exp(-(h @ self.out + self.offset)))


def _summed(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    if not len(key):
        return key, rows
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(rows[order], first, axis=0)


def train(docs: list[list[str]], label: np.ndarray, language: np.ndarray, seed: int) -> Net:
    """Adam on the logistic loss, with dropout of pooled features and of words. The order of the steps is fixed by the seed.

    Unfit documents weigh more than clean ones, and more so in languages with few of them.
    """
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    dense = {"bias": net.bias, "out": net.out} | {f"f{i}": f for i, f in enumerate(net.filters)}
    m = {k: np.zeros_like(v) for k, v in dense.items()}
    v2 = {k: np.zeros_like(v) for k, v in dense.items()}
    seen = np.zeros((SLOTS, 1), np.float32)
    known: dict[str, list[int]] = {}
    step = 0
    weight = np.where(label > 0, min(4.0, max(1.0, (len(label) - label.sum()) / max(1, label.sum()) / 3)), 1.0)
    unfit = {x: max(1, int(label[language == x].sum())) for x in set(language)}
    weight *= np.where(label > 0, [min(3.0, np.sqrt(max(unfit.values()) / unfit[x])) for x in language], 1.0)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            t = Texts.of([docs[i] for i in own], known)
            kept = np.where(rng.random(len(t.words)) < 0.08, 0, t.words)
            t = Texts(kept, t.starts, t.piece, t.piece_starts)
            e = net.embed(t)
            best, acts = net.pooled(t, e)
            mask = (rng.random(best.shape) >= 0.25) / 0.75
            lin = best + net.bias
            h = np.maximum(lin, 0) * mask
            p = 1 / (1 + np.exp(-(h @ net.out + net.offset)))
            err = (p - label[own]) * weight[own] / len(own)
            grads = {"out": h.T @ err + 1e-4 * net.out}
            back = err[:, None] * net.out[None, :] * mask * (lin > 0)
            grads["bias"] = back.sum(0)
            touched, deltas = [], []
            for i, w in enumerate(WIDTHS):
                a = acts[i]
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                top = best[:, i * FILTERS : (i + 1) * FILTERS]
                doc = np.searchsorted(t.starts, np.arange(len(a)), side="right") - 1
                row, col = np.nonzero(a == top[doc])
                d = doc[row]
                flat = np.full(g.shape, -1, np.int64)
                flat[d[::-1], col[::-1]] = row[::-1]
                dd, cc = np.nonzero((g != 0) & (flat >= 0))
                at, val = flat[dd, cc], g[dd, cc].astype(np.float32)
                gf = np.zeros_like(net.filters[i])
                pick = np.zeros((len(at), FILTERS), np.float32)
                pick[np.arange(len(at)), cc] = val
                for j in range(w):
                    words = t.words[at + j]
                    gf[j] = e[words].T @ pick
                    touched.append(words)
                    deltas.append(pick @ net.filters[i][j].T)
                grads[f"f{i}"] = gf + 1e-5 * net.filters[i]
            moved, ge = _summed(np.concatenate(touched), np.concatenate(deltas))
            moved, ge = moved[moved > 0], ge[moved > 0]
            step += 1
            for k, x in dense.items():
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v2[k] = 0.999 * v2[k] + 0.001 * grads[k] ** 2
                x -= (2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.offset -= 2e-2 * float(err.sum())
            n = np.diff(np.append(t.piece_starts, len(t.piece)))[moved]
            at = np.repeat(t.piece_starts[moved] - np.cumsum(n) + n, n) + np.arange(n.sum())
            used, total = _summed(t.piece[at], np.repeat(ge / np.sqrt(n)[:, None], n, axis=0))
            seen[used] += (total**2).mean(1, keepdims=True)
            net.table[used] -= 0.05 * total / (np.sqrt(seen[used]) + 1e-6)
    return net


def _best_threshold(score: np.ndarray, label: np.ndarray, clean: float) -> float:
    """Threshold of the highest F1 with clean documents weighted by ``clean``, halfway to the next score, from 0.5 to 0.9."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (hit + np.cumsum(1 - y) * clean + max(1, y.sum()))
    k = int(np.argmax(f1))
    return min(0.9, max(0.5, float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)))


def scores(net: Net, docs: list[list[str]]) -> np.ndarray:
    known: dict[str, list[int]] = {}
    parts = [net.score(Texts.of(docs[lo : lo + 200], known)) for lo in range(0, len(docs), 200)]
    return np.concatenate(parts) if parts else np.empty(0)


@dataclass(frozen=True)
class Held:
    """Trusted labels with their languages and out-of-half scores, and the share of unfit ones by the final net."""

    score: np.ndarray
    label: np.ndarray
    language: np.ndarray
    often: float


def fit(docs: list[list[str]], label: np.ndarray, language: list[str], corpus: list[list[str]]) -> Net:
    """Train and calibrate on a corpus that is at hand as a whole."""
    net, held = train_trusted(docs, label, language)
    calibrate(net, held, _share(scores(net, corpus)))
    return net


def _in_tasks(spark: SparkSession | None, n: int, make: Callable[[int], tuple]) -> list[tuple]:
    """``make(0)`` to ``make(n - 1)``, tuples of numpy arrays and numbers, each in a Spark task of its own if there is a session."""
    if spark is None:
        return [make(i) for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(make(i))], pa.binary())], names=["id", "made"])

    rows = spark.range(0, n, 1, n).mapInArrow(run, "id long, made binary").collect()
    return [pickle.loads(r["made"]) for r in sorted(rows, key=lambda r: r["id"])]


def train_trusted(docs: list[list[str]], label: np.ndarray, language: list[str], spark: SparkSession | None = None) -> tuple[Net, Held]:
    """Train on labels of which some are wrong; with a session in its tasks, the halves side by side.

    Two nets, each trained on one half, judge the other half. Labels that such a net plainly
    contradicts are left out when the final net is trained; in languages with few unfit documents
    the contradiction has to be stronger.
    """
    label = label.astype(np.float64)
    lang = np.array(language)
    half = np.random.default_rng(SEED).permutation(len(docs)) % 2
    held = np.full(len(docs), 0.5)

    def judge(h: int) -> tuple:
        own, rest = np.flatnonzero(half != h), np.flatnonzero(half == h)
        if label[own].sum() < 2 or not len(rest):
            return rest[:0], held[:0]
        return rest, scores(train([docs[i] for i in own], label[own], lang[own], SEED + h), [docs[i] for i in rest])

    for rest, score in _in_tasks(spark, 2, judge):
        held[rest] = score
    sure = np.array([label[lang == x].sum() >= SURE_LABELS for x in language], bool)
    trusted = np.flatnonzero(~((label == 1) & (held < np.where(sure, 0.15, 0.02))) & ~((label == 0) & (held > 0.9)))
    if label[trusted].sum() < 2:
        trusted = np.arange(len(docs))
    own = [docs[i] for i in trusted]

    def final(_: int) -> tuple:
        net = train(own, label[trusted], lang[trusted], SEED + 2)
        return net.table, net.filters, net.bias, net.out, net.offset, _share(scores(net, own))

    *parts, often = _in_tasks(spark, 1, final)[0]
    return Net(*parts), Held(held[trusted], label[trusted], lang[trusted], often)


def _share(score: np.ndarray) -> float:
    return float(np.mean(score > SURE)) if len(score) else 0.5


def calibrate(net: Net, held: Held, rare: float) -> None:
    """Choose the thresholds by language, ``rare`` being the share of unfit documents in the whole corpus.

    Thresholds maximise F1 on the out-of-half scores, for each language with ``LEAST_LABELS``
    labels, else over all. Clean documents weigh in it as they would in the corpus, where
    unfit ones are rarer than among the labelled.
    """
    often, rare = (np.clip(x, 0.001, 0.999) for x in (held.often, rare))
    clean = max(1.0, (1 - rare) / (1 - often) * often / rare)
    net.thresholds = {"*": _best_threshold(held.score, held.label, clean)}
    for one in sorted(set(held.language.tolist())):
        own = held.language == one
        if own.sum() >= LEAST_LABELS and held.label[own].sum() >= 10:
            net.thresholds[one] = _best_threshold(held.score[own], held.label[own], clean)


def language_of(lang: Column) -> Column:
    """Two-letter code of a language tag of any spelling; empty where it is unknown."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.coalesce(code, F.lit(""))


def train_on(docs: DataFrame, doc_id: str, text: str, lang: str, reviews: DataFrame, review_id: str, label: str) -> tuple[Net, Held] | None:
    """Train on at most ``FIT_UNFIT`` and ``FIT_CLEAN`` reviewed documents, chosen by a hash of the id; None without labels of both kinds.

    A document with as many unfit as clean reviews has no label; other labels than the two count as none.
    """
    vote = F.lower(F.trim(F.col(label)))
    votes = (
        reviews.select(F.col(review_id).cast("long").alias("id"), F.when(vote == "unfit", 1).when(vote == "clean", -1).alias("v"))
        .where("id is not null and v is not null")
        .groupBy("id")
        .agg(F.sum("v").alias("v"))
    )
    chosen = None
    for sign, most in ((1, FIT_UNFIT), (-1, FIT_CLEAN)):
        part = votes.where(F.col("v") * sign > 0).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = _rows(docs, doc_id, text, lang)
    # at most FIT_UNFIT + FIT_CLEAN ids are broadcast, and as many texts come to the driver
    rows = rows.where("text is not null").join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    got = sorted(rows.select("id", "text", "lang", "v").toLocalIterator(), key=lambda r: r["id"])
    marks = np.array([r["v"] > 0 for r in got])
    if not marks.any() or marks.all():
        return None
    return train_trusted([tokens(r["text"]) for r in got], marks, [r["lang"] for r in got], docs.sparkSession)


def fit_on(docs: DataFrame, doc_id: str, text: str, lang: str, reviews: DataFrame, review_id: str, label: str) -> Net | None:
    """The net of :func:`train_on`, with thresholds for the whole of ``docs``."""
    trained = train_on(docs, doc_id, text, lang, reviews, review_id, label)
    if trained is None:
        return None
    net, held = trained
    calibrate(net, held, _share_of(_scored(docs, doc_id, text, lang, net)))
    return net


def score_rows(net: Net):
    """mapInArrow function: ``(id, text, lang)`` to ``(id, lang, score)``, over whole texts; a null text has a null score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                texts = b.column("text").to_pylist()
                docs = [tokens(t or "") for t in texts]
                score = net.score(Texts.of(docs, known)).astype(np.float64)
                score[[not d for d in docs]] = 0
                given = pa.array(score, mask=np.array([t is None for t in texts], bool))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), given], names=["id", "lang", "score"])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), language_of(F.col(lang)).alias("lang"))


def _scored(docs: DataFrame, doc_id: str, text: str, lang: str, net: Net) -> DataFrame:
    return _rows(docs, doc_id, text, lang).mapInArrow(score_rows(net), "id long, lang string, score double")


def _share_of(scored: DataFrame) -> float:
    """Share of unfit documents among all rows with a text."""
    share = scored.agg(F.avg((F.col("score") > SURE).cast("int")).alias("share")).head()["share"]
    return 0.5 if share is None else share


def _flagged(scored: DataFrame, net: Net) -> DataFrame:
    """``(id, score, flagged)`` of scored rows with an id."""
    cut = F.lit(net.thresholds["*"])
    own = [F.lit(x) for item in net.thresholds.items() for x in item]
    score = F.coalesce("score", F.lit(0.0))
    return scored.where("id is not null").select("id", score.alias("score"), (score >= F.coalesce(F.try_element_at(F.create_map(*own), F.col("lang")), cut)).alias("flagged"))


def score_documents(docs: DataFrame, doc_id: str, text: str, lang: str, net: Net | None) -> DataFrame:
    """``(id, score, flagged)`` of every row with an id: the score from 0 to 1, and whether it reaches its language's threshold.

    The net, of fixed size, goes to the executors; documents aren't shuffled.

    Defined cases: a null, empty or wordless text scores 0 and isn't flagged; without a net (no
    labels of both kinds) every score is null and nothing is flagged; a row given twice is scored twice.
    """
    if net is None:
        rows = _rows(docs, doc_id, text, lang).where("id is not null")
        return rows.select("id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"))
    return _flagged(_scored(docs, doc_id, text, lang, net), net)


def fit_and_score(docs: DataFrame, doc_id: str, text: str, lang: str, reviews: DataFrame, review_id: str, label: str) -> DataFrame:
    """:func:`score_documents` with the net of :func:`fit_on`, every document being scored once."""
    trained = train_on(docs, doc_id, text, lang, reviews, review_id, label)
    if trained is None:
        return score_documents(docs, doc_id, text, lang, None)
    net, held = trained
    scored = stored(_scored(docs, doc_id, text, lang, net), "unfit")
    calibrate(net, held, _share_of(scored))
    return _flagged(scored, net)
