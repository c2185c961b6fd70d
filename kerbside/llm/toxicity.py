"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A document's features are its distinct words and their stems (leading characters), each counted once for
every distinct word that has it. One weight vector is shared by all thresholds: P(grade <= k) is the
logistic function of ``threshold_k - weights * features``, with ordered thresholds. A document's score is
its expected grade, the sum over k of P(grade > k).

Labels say only toxic or not. The grades of toxic documents in the sample are made from them: words and
stems that are significantly more frequent in toxic documents are markers, and toxic documents are graded 1
to 3 by how many distinct marked words they hold (thirds of the sample); all others are grade 0.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most, and the words of each that are looked at.
SAMPLE = 6000
GRADES, STEMS = 3, (4, 5, 6)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """The features of one lower-cased word: itself without outer marks, and its stems."""
    bare = _EDGES.sub("", word)
    return [f"w:{bare}", *(f"s:{bare[:n]}" for n in STEMS if len(bare) > n)] if bare else []


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Ordinal:
    """A fitted model: feature weights, ordered thresholds, and the expected grade from which a text is toxic."""

    weights: dict[str, float]
    thresholds: list[float]
    cutoff: float = 0.5

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 300_000:
                self._known.clear()
            get = self.weights.get
            found = self._known[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def activation(self, words: set[str]) -> float:
        """The weighted sum of the features of one whole text, given as its distinct words."""
        known = self._known
        return math.fsum(known[w] if w in known else self.word_weight(w) for w in words)

    def expected(self, activation: np.ndarray) -> np.ndarray:
        """The expected grade (0 to the number of thresholds)."""
        z = np.asarray(activation)[:, None] - np.array(self.thresholds)[None, :]
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).sum(axis=1)


def _markers(docs: list[set[str]], toxic: np.ndarray, z_least: float = 5.0, ratio: float = 10.0) -> list[str]:
    """Features significantly (two-proportion z) and many times more frequent in toxic documents."""
    counts = (Counter(), Counter())
    for words, t in zip(docs, toxic):
        counts[int(t)].update({f for w in words for f in features(w)})
    no, yes = counts
    n_yes, n_no = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = []
    for f, a in yes.items():
        b = no[f]
        share = (a + b) / (n_yes + n_no)
        error = math.sqrt(share * (1 - share) * (1 / n_yes + 1 / n_no))
        if a / n_yes - b / n_no > z_least * error and a / n_yes > ratio * b / n_no:
            found.append(f)
    return sorted(found)


def _without_copies(docs: list[set[str]], toxic: np.ndarray) -> list[int]:
    """Positions of documents that repeat no earlier one of their label: a group of copies would pass its own words off as markers.

    Of documents with one label and the same three smallest word hashes those go that share four fifths of
    their words with one that stays.
    """
    seen: dict[tuple, list[int]] = defaultdict(list)
    for i, words in enumerate(docs):
        like = seen[(bool(toxic[i]), *heapq.nsmallest(3, (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)))]
        if not any(5 * len(words & docs[j]) >= 4 * len(words | docs[j]) for j in like):
            like.append(i)
    return sorted(i for kept in seen.values() for i in kept)


def fit_ordinal(docs: list[set[str]], toxic: list[bool], steps: int = 400, ridge: float = 1e-4) -> Ordinal:
    """Fit on the distinct words of whole texts with labels; deterministic. Without both labels, or markers, nothing is ever toxic."""
    y = np.array(toxic, dtype=bool)
    never = Ordinal({}, [30.0] * GRADES)
    if len(y) == 0 or y.all() or not y.any():
        return never
    first = _without_copies(docs, y)
    docs, y = [docs[i] for i in first], y[first]
    names = _markers(docs, y) if y.any() and not y.all() else []
    if not names:
        return never
    index = {f: k for k, f in enumerate(names)}
    pairs = [(i, index[f]) for i, words in enumerate(docs) for w in words for f in features(w) if f in index]
    at, col = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    hits = np.bincount(at, minlength=len(y))
    # Grades 1 to GRADES by thirds of the toxic documents' marked words.
    edges = np.quantile(hits[y], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(y, 1 + (hits[:, None] > edges[None, :]).sum(axis=1), 0)
    weights, base, gaps = np.zeros(len(names)), 2.0, np.zeros(GRADES - 1)
    above = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    balance = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    state = [np.zeros_like(x) for x in (weights, np.zeros(1), gaps) for _ in range(2)]
    for step in range(1, steps + 1):  # Adam on the summed binary cross-entropies of "grade > k"
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(at, weights[col], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts[None, :], -60, 60)))
        slope = (p - above) * balance[:, None]
        per_cut = -slope.sum(axis=0)
        grads = [np.bincount(col, slope.sum(axis=1)[at], minlength=len(names)) + ridge * weights, np.array([per_cut.sum()]), np.array([per_cut[k + 1 :].sum() for k in range(GRADES - 1)]) * np.exp(gaps)]
        moves = []
        for k, g in enumerate(grads):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            moves.append(0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        weights, base, gaps = weights - moves[0], base - float(moves[1][0]), gaps - moves[2]
    cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return Ordinal(dict(zip(names, weights.tolist())), cuts.tolist())


def choose_cutoff(model: Ordinal, docs: list[set[str]], toxic: list[bool]) -> None:
    """Set the cutoff to the middle of the expected grades between which held-out F1 is best."""
    y = np.array(toxic, dtype=bool)
    if not y.any() or not model.weights:
        return
    score = model.expected(np.array([model.activation(words) for words in docs]))
    order = np.argsort(-score, kind="stable")
    s, right = score[order], np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cutoff between equal scores
    k = int(f1.argmax())
    model.cutoff = float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model from at most ``sample`` labelled documents, a quarter of them held out for the cutoff.

    The sample is that with the smallest digests of ``doc_id``, half of it toxic where there are enough.
    Null labels and documents without a label are left out. An id with conflicting labels is toxic; an id
    that several rows share is one document, the least of their texts. Only this bounded sample reaches the
    driver, as distinct words.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__doc")).agg(F.max(F.col("toxic") > 0).alias("__toxic"))
    chosen = known.where("__toxic").orderBy(F.md5(F.col("__doc").cast("string"))).limit(sample // 2)
    chosen = chosen.unionByName(known.where("not __toxic").orderBy(F.md5(F.col("__doc").cast("string"))).limit(sample - sample // 2))
    found = docs.select("doc_id", F.col("text").cast("string").alias("__text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    one = found.groupBy("__doc").agg(F.min("__text").alias("__text"), F.first("__toxic").alias("__toxic"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(distinct_words(t.as_py()))) for t in batch.column(1)], pa.string()), batch.column(2)], names=["id", "words", "toxic"])

    rows = one.select(F.col("__doc").cast("long"), "__text", "__toxic").mapInArrow(shorten, "id long, words string, toxic boolean").toPandas().sort_values("id")
    held = np.array([int(hashlib.md5(f"held:{i}".encode()).hexdigest(), 16) % 4 == 0 for i in rows["id"]], dtype=bool)
    words, toxic = [distinct_words(t) for t in rows["words"]], rows["toxic"].to_numpy(dtype=bool)
    part = lambda take: ([w for w, t in zip(words, take) if t], toxic[take].tolist())
    model = fit_ordinal(*part(~held))
    choose_cutoff(model, *part(held))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Ordinal, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        yield batch, model.expected(np.array([model.activation(distinct_words(t.as_py())) for t in batch.column(at)], dtype=float))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (nearest whole one) and ``toxic`` for every row, over whole texts.

    Null and empty texts have the severity of a text without features. Rows that repeat stay.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, model, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(np.rint(s).astype(np.int32)), pa.array(s >= model.cutoff)], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, severity double, grade int, toxic boolean")


def keep_civil(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of ``docs`` whose text is not toxic, with their columns; nothing is shuffled."""
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in _scored(batches, model, at):
            yield batch.filter(pa.array(s < model.cutoff))

    return docs.mapInArrow(sift, docs.schema)
