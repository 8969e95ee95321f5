"""Toxicity by multiple-instance learning.

Labels mark documents; sentences are the instances. A sentence has the chance
sigmoid(bias + weights of its different words), a document the noisy-or of its sentences:
toxic unless every sentence is clean. Training follows the gradient through the
noisy-or, so that blame settles on the sentences that tell labels apart, and the
same scores then locate offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, row_texts, table, with_text

#: Labelled documents of each label that the classifier is fitted on at most.
SAMPLE = 2500
#: Features kept, best first.
FEATURES = 1 << 15
#: Documents of the sample that a feature must occur in.
LEAST = 3
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)

_sentence = re.compile(r"[^.!?\n]+[.!?]*")
_word = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[str]:
    return [m[0] for m in _sentence.finditer(text)]


def word_features(word: str) -> list[str]:
    """Names of the features of a lower-cased word."""
    return ["=" + word] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n]


@dataclass
class Model:
    """At most FEATURES weights, so its size doesn't depend on the corpus."""

    bias: float
    weights: dict[str, float]
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "cache": {}}

    def _word(self, word: str) -> float:
        if len(self.cache) > 200_000:
            self.cache.clear()
        w = self.cache[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return w

    def sentence(self, text: str) -> float:
        """Chance that a sentence is toxic."""
        get, z = self.cache.get, self.bias
        for w in set(_word.findall(text.lower())):
            v = get(w)
            z += self._word(w) if v is None else v
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

    def score(self, text: str) -> float:
        """Noisy-or of the sentences; a text without any scores as one of no words."""
        get, clean, base = self.cache.get, 0.0, float(np.log1p(np.exp(self.bias)))
        for m in _sentence.finditer(text.lower()):
            z = 0.0
            for w in set(_word.findall(m[0])):
                v = get(w)
                z += self._word(w) if v is None else v
            clean += base if not z else float(np.logaddexp(0.0, min(50.0, self.bias + z)))
        return float(-np.expm1(-(clean or base)))


def fit(texts: list[str], labels: list[int], steps: int = 400, rate: float = 0.1, l1: float = 1e-4) -> Model:
    """Noisy-or logistic regression by Adam. Only features that toxic documents
    have oftener take part: a clean word is no evidence against a toxic one.
    Without both labels the model says what it has seen; without rows, 0."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(12.0 if len(y) and y[0] else -12.0, {})
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels, strict=True):
        own = set()
        for w in set(_word.findall(text.lower())):
            own.update(word_features(w))
        seen[label].update(own)
    n1, n0 = y.sum(), (1 - y).sum()
    gain = {}
    for f, a in seen[1].items():
        p, q = (a + 0.5) / (n1 + 1), (seen[0][f] + 0.5) / (n0 + 1)
        if a + seen[0][f] >= LEAST and p > 1.5 * q:
            gain[f] = a * np.log(p / q)
    kept = sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(kept)}
    rows, cols, doc_of, n = [], [], [], 0
    plain = np.zeros(len(y))  # sentences without any kept feature
    known: dict[str, list[int]] = {}
    for d, text in enumerate(texts):
        count = 0
        for m in _sentence.finditer(text.lower()):
            count += 1
            fs: list[int] = []
            for w in set(_word.findall(m[0])):
                if w not in known:
                    known[w] = [index[f] for f in word_features(w) if f in index]
                fs += known[w]
            if fs:
                rows += [n] * len(fs)
                cols += fs
                doc_of.append(d)
                n += 1
            else:
                plain[d] += 1
        plain[d] += not count
    r, c, dd = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc_of, np.int64)
    theta = np.zeros(len(kept) + 1)
    theta[-1] = -6.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        b = theta[-1]
        z = b + np.bincount(r, theta[c], n)
        soft, sig = np.logaddexp(0.0, z), 1 / (1 + np.exp(-z))
        clean = np.bincount(dd, soft, len(y)) + plain * np.logaddexp(0.0, b)
        p = -np.expm1(-clean)
        # d loss / d clean: y = 0 gives 1, y = 1 gives -(1 - p) / p.
        g = np.where(y > 0, -np.exp(-clean) / np.maximum(p, 1e-12), 1.0) * np.where(y > 0, 0.5 / n1, 0.5 / n0)
        gz = g[dd] * sig
        grad = np.r_[np.bincount(c, gz[r], len(kept)), gz.sum() + (g * plain).sum() / (1 + np.exp(-b))]
        grad[:-1] += l1  # no weight is negative
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return Model(float(theta[-1]), {f: float(w) for f, w in zip(kept, theta, strict=False) if w > 1e-3})


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each label, the ones with the
    least hash of doc_id, among those that ``learnable`` (over doc_id) admits. Null
    labels and texts are passed over; a doc_id labelled both ways counts as toxic."""
    known = labels.where(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    # At most 2 * sample ids.
    ids = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").where("text IS NOT NULL").orderBy("doc_id").collect()
    return fit([r.text for r in rows], [r.toxic for r in rows])


def _scores(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [model.score(t or "") for t in row_texts(b)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.float64())], ["_row", "_score"])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``_row``, a struct of the ``keep`` columns of ``docs``, and the ``_score`` of each
    whole text. Null and empty texts score as one sentence without words; repeated
    rows each have a score; an empty table gives no rows; columns of any name pass."""
    arrow_batches(docs.sparkSession)
    rows = with_text(docs, keep)
    return rows.mapInArrow(partial(_scores, model), T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())]))


def _offending(model: Model, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(i, k, s.strip(), p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s in enumerate(sentences(t or "")) if (p := model.sentence(s)) >= least]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "sentence_no", "sentence", "score"])


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, sentence, score) of the sentences that offend."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_offending, model, least), "doc_id long, sentence_no long, sentence string, score double")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label may be learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 3 == 1


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model, ["doc_id"]).select("_row.doc_id", F.col("_score").alias("score"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
