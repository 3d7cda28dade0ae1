"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the features of its words (the word and
its groups of five letters). A document is toxic if any of its sentences is: its probability is
the noisy-or 1 - (1 - leak) * product(1 - p), so only document labels are needed to train the
sentence scores, and these then point at the offending sentences.

The fit runs on a bounded sample of labelled documents (``sample`` rows, those of lowest hash),
the only rows that reach the driver; scoring is a pass over all documents with a weight table
of at most ``features`` entries.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import free_name, only_memory, whole_text

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
MEMORY = 120_000
BUCKETS = 1 << 20
HASH = xxhash.xxh32_intdigest


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float
    leak: float


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its groups of five letters, ends marked."""
    marked = f"<{word}>"
    groups = [f"={word}", *[marked[i:i + 5] for i in range(len(marked) - 4)]]
    return sorted({HASH(g) % BUCKETS for g in groups})


class Bags:
    """Labelled documents as sentences of word numbers."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.features: list[np.ndarray] = []  # of each word
        self.docs: list[list[np.ndarray]] = []  # of each document, its sentences
        self.toxic: list[int] = []

    def add(self, text: str, toxic: int) -> None:
        sentences = []
        for s in SENTENCE.findall(text.lower()):
            words = set(WORD.findall(s))
            for w in words:
                if w not in self.numbers:
                    self.numbers[w] = len(self.features)
                    self.features.append(np.array(word_features(w), np.int32))
            if words:
                sentences.append(np.array(sorted(self.numbers[w] for w in words), np.int32))
        self.docs.append(sentences)
        self.toxic.append(toxic)


def _selected(bags: Bags, toxic: np.ndarray, features: int, least: int) -> np.ndarray:
    """Features whose share among toxic documents is above the others' by the most standard errors."""
    count, among = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for doc, y in zip(bags.docs, toxic, strict=True):
        if doc:
            found = np.unique(np.concatenate([bags.features[w] for w in np.unique(np.concatenate(doc))]))
            count[found] += 1
            among[found] += y
    n, base = len(toxic), toxic.mean()
    z = (among - count * base) / np.sqrt(count * base * (1 - base) * (1 - count / n) + 1.0)
    order = np.lexsort((np.arange(BUCKETS), -z))
    return order[(z[order] > 3.0) & (count[order] >= least)][:features]


def fit(bags: Bags, features: int = 2_000, least: int = 4, steps: int = 300, decay: float = 2e-4) -> Model:
    """Sentence weights from document labels, by gradient descent on the noisy-or likelihood.

    Without labels of both kinds the model gives every document the share of toxic ones.
    """
    y = np.array(bags.toxic, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, -50.0, float(y.mean()) if len(y) else 0.0)
    chosen = _selected(bags, y, features, least)
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    mine = [c[c >= 0] for c in (column[f] for f in bags.features)]
    docs, rows, cols = [], [], []
    for d, doc in enumerate(bags.docs):
        for s in doc:
            parts = [mine[w] for w in s if len(mine[w])]
            if parts:  # a sentence without features is part of the leak
                found = np.unique(np.concatenate(parts))
                rows.append(np.full(len(found), len(docs)))
                cols.append(found)
                docs.append(d)
    sentences, docs = len(docs), np.array(docs, dtype=np.int64)
    rows, cols = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (rows, cols))
    w, bias, leak = np.zeros(len(chosen)), -2.0, -4.0
    m = [np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)]
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], sentences) + bias
        p = 1 / (1 + np.exp(-z))
        q = 1 / (1 + np.exp(-leak))
        clean = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-q)
        whole = np.maximum(-np.expm1(clean), 1e-9)
        pull = 1 - y / whole  # of the loss, by minus the logarithm of the clean probability
        gz = pull[docs] * p
        grad = np.concatenate([np.bincount(cols, gz[rows], len(chosen)), [gz.sum(), (pull * q).sum()]]) / len(y)
        grad[:-2] += decay * w
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        move = 0.1 * (m[0] / (1 - 0.9 ** t)) / (np.sqrt(m[1] / (1 - 0.99 ** t)) + 1e-8)
        w, bias, leak = w - move[:-2], bias - move[-2], leak - move[-1]
    kept = {int(f): float(v) for f, v in zip(chosen, w, strict=True) if abs(v) > 1e-4}
    return Model(kept, float(bias), float(1 / (1 + np.exp(-leak))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, doc: str, text: str, label: str) -> Bags:
    """Words and labels of at most ``sample`` labelled documents, those of lowest hash.

    A document with several labels is toxic if one says so; null labels and ids are no labels.
    """
    known = (labels.select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
             .groupBy("_id").agg(F.max("_y").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # at most ``sample`` ids, so the documents are not shuffled to meet them
    found = docs.select(F.col(doc).alias("_id"), whole_text(text).alias("_t")).join(F.broadcast(known), "_id")
    rows = found.groupBy("_id").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"), F.first("_y").alias("_y"))
    bags = Bags()
    for r in rows.orderBy("_id").toLocalIterator():
        bags.add(r["_t"], int(r["_y"] > 0))
    return bags


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, doc: str = "doc_id", text: str = "text",
          label: str = "toxic", **options) -> Model:
    return fit(labelled_sample(docs, labels, sample, doc, text, label), **options)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.before = model, {}, {}
        self.own = {f: f for f in model.weights}  # words remember the model's strings, not copies of them

    def word(self, word: str) -> tuple[int, ...]:
        """Features of a word that have a weight; remembered, what was not used for long forgotten."""
        found = self.before.get(word)
        if found is None:
            found = tuple(self.own[f] for f in word_features(word) if f in self.own)
        if len(self.known) >= MEMORY:
            self.before, self.known = self.known, {}
        self.known[word] = found
        return found

    def score(self, text: str, offending: float) -> tuple[float, list[tuple[int, int, float]]]:
        weights, bias = self.model.weights, self.model.bias
        clean, places = 1.0 - self.model.leak, []
        lower = text.lower()
        if len(lower) != len(text):  # a few capitals become two characters
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for m in SENTENCE.finditer(lower):
            features = set()
            for w in WORD.findall(m[0]):
                found = self.known.get(w)
                features.update(self.word(w) if found is None else found)
            if not features:
                continue
            z = bias + sum(weights[f] for f in sorted(features))
            p = 1 / (1 + math.exp(-max(-700.0, z)))
            clean *= 1 - p
            if p >= offending:
                places.append((m.start(), m.end(), p))
        return float(min(1.0, max(0.0, 1 - clean))), places


_ready: dict[tuple, Scorer] = {}


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score", offending: str = "offending",
                   at_least: float = 0.5) -> DataFrame:
    """Adds each whole text's score and its offending sentences (start, end, probability).

    Starts and ends are code points, the end exclusive; sentences end at ``.!?`` or a line's
    end. Null and empty texts get the leak, the score of a text without any sign. Existing
    columns of these names are replaced.
    """
    place = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                        StructField("p", DoubleType())])
    kind = StructType([StructField("score", DoubleType()), StructField("places", ArrayType(place))])
    key = (len(model.weights), model.bias, model.leak, hash(frozenset(model.weights.items())))

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        only_memory("toxicity", _ready.clear)
        if key not in _ready:
            _ready.clear()
            _ready[key] = Scorer(model)
        scores, places = [], []
        for t in texts:
            s, found = _ready[key].score(t.as_py() or "", at_least)
            scores.append(s)
            places.append([{"start": a, "end": b, "p": p} for a, b, p in found])
        arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(places, arrow)], ["score", "places"])

    both = free_name(docs, "_scored")
    return docs.withColumn(both, scored(whole_text(text))).withColumns(
        {out: F.col(f"{both}.score"), offending: F.col(f"{both}.places")}).drop(both)


def held_out(doc: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))
