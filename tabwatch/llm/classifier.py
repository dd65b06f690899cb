"""Supervised subword embeddings: a quality score of whole texts.

A text is the bag of its words; a word is itself and its character n-grams, hashed into a fixed
number of buckets, and a word that follows an equal one adds the word bigram "x x" (bigrams are
hashed by which of their words agree, so that it is one bucket for all x). Every bucket has a
learned vector; the text's hidden vector is their average and a softmax layer gives the class.
Learning is stochastic gradient descent in numpy over a bounded sample of labelled texts.

Learned, the class score of a text is linear in its buckets: each bucket is one number, each
word the sum of its buckets, and a text is scored by looking up its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import give_back, prepare, utf8

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 2.0
#: Labelled texts of each class that are learned from, at most.
MOST_PER_CLASS = 1500
#: Words kept by a worker, and the longest of them (in bytes).
MAX_CACHED = 500_000
MAX_WORD = 64
SAME = 0  # bucket of the bigram of two equal words
_SAMPLE = "doc_id long, label int, n long, buckets binary, counts binary"


def word_buckets(word: bytes) -> list[int]:
    """The buckets of a word: itself, and the n-grams of "<word>"."""
    own = [1 + zlib.crc32(word) % (BUCKETS - 1)]
    marked = "<" + word.decode("utf-8", "replace") + ">"
    for n in NGRAMS:
        own += [1 + zlib.crc32(marked[i:i + n].encode(), n) % (BUCKETS - 1) for i in range(len(marked) - n + 1)]
    return own


def text_buckets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = text.split()
    cache: dict[bytes, list[int]] = {}
    out: list[int] = []
    for w in words:
        if w not in cache:
            cache[w] = word_buckets(w)
        out += cache[w]
    out += [SAME] * sum(a == b for a, b in zip(words, words[1:]))
    return np.unique(np.array(out, np.int32), return_counts=True)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, class 1 against class 0
    bias: float  # log odds of the classes among all labelled texts, against the sample's


def learn(examples: list[tuple[int, np.ndarray, np.ndarray]], odds: float, seed: int = 3) -> Model:
    """Vectors and softmax layer for (label, buckets, counts) examples, in the given order.

    ``odds`` is the log odds of label 1 that is added to every score (the prior of all labelled
    texts against that of the sample). Without examples of both classes all weights are 0.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if len({e[0] for e in examples}) < 2:
        return Model(np.zeros(BUCKETS), odds)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            label, own, counts = examples[k]
            done += 1
            if not len(own):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[own]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            wrong = p / p.sum()
            wrong[label] -= 1
            step = np.float32(RATE * (1 - (done - 1) / steps))
            back = layer.T @ wrong
            layer -= step * np.outer(wrong, hidden)
            bias -= 0.1 * step * wrong
            vectors[own] -= step * (share / np.sqrt((share * share).sum()))[:, None] * back
    out = layer[1] - layer[0]
    return Model((vectors @ out).astype(np.float64), float(bias[1] - bias[0]) + odds)


class _Words(dict):
    """word -> its place in growing arrays of sums and sizes."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.sums, self.sizes = np.zeros(1 << 16), np.zeros(1 << 16)

    def __missing__(self, word: bytes) -> int:
        own = word_buckets(word)
        k = len(self)
        if k == len(self.sums):
            self.sums, self.sizes = (np.concatenate([x, np.zeros(len(x))]) for x in (self.sums, self.sizes))
        self.sums[k], self.sizes[k] = self.weights[own].sum(), len(own)
        self[word] = k
        return k


def scores(texts: list[bytes], model: Model, words: _Words | None = None) -> list[float]:
    """Probability of label 1 for each text; an empty one has the prior."""
    words = _Words(model.weights) if words is None else words
    out = []
    for text in texts:
        own = text.split()
        if len(words) > MAX_CACHED:
            words.clear()
        total = n = 0.0
        if own and max(map(len, own)) > MAX_WORD:  # long words are not kept
            for w in own:
                if len(w) > MAX_WORD:
                    b = word_buckets(w)
                    total, n = total + float(model.weights[b].sum()), n + len(b)
        at = np.fromiter((words[w] for w in own if len(w) <= MAX_WORD) if n else map(words.__getitem__, own), np.int64)
        total, n = total + float(words.sums[at].sum()), n + float(words.sizes[at].sum())
        same = int((at[1:] == at[:-1]).sum()) if not n or len(at) == len(own) else sum(a == b for a, b in zip(own, own[1:]))
        z = model.bias + ((total + same * model.weights[SAME]) / (n + same) if n else 0.0)
        out.append(float(1 / (1 + np.exp(-min(50.0, max(-50.0, z))))))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [text_buckets(x.as_buffer().to_pybytes()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([int(c.sum()) for _, c in own], pa.int64()),
            pa.array([b.astype("<i4").tobytes() for b, _ in own], pa.binary()),
            pa.array([c.astype("<i4").tobytes() for _, c in own], pa.binary())],
            names=["doc_id", "label", "n", "buckets", "counts"])


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs`` (doc_id, text).

    At most ``most_per_class`` labelled rows of each class, those with the smallest hashes of
    doc_id, give their whole texts; the class prior is counted over all labelled rows. Null ids
    or labels are left out. A text that repeats under one id and label counts once, and of an id with
    very many texts those with the smallest hashes count, so that no more than ``most_per_class``
    texts of a class are ever gathered.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id is not null and label in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    prior = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    keyed = texts.join(F.broadcast(chosen[0].union(chosen[1]).distinct()), "doc_id").select("doc_id", "label", "text", F.md5("text").alias("hash"))
    keyed = keyed.dropDuplicates(["doc_id", "label", "hash"])
    sample = [keyed.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(most_per_class) for k in (0, 1)]
    sample = sample[0].union(sample[1]).select("doc_id", "label", "text")
    rows = sample.mapInArrow(_features, _SAMPLE).collect()  # 2 * most_per_class rows of BUCKETS entries at most
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["buckets"])))
    seen = [sum(r["label"] == k for r in rows) for k in (0, 1)]
    odds = np.log((prior.get(1, 0) + 1) / (prior.get(0, 0) + 1)) - (np.log(seen[1] / seen[0]) if min(seen) else 0.0)
    return learn([(r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in rows], float(odds))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) and the column score; null texts score as empty ones.

    All columns stay as they are; a column of that name is replaced. No rows, no scores.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles: 1 MB

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(shared.value.weights)
        for batch in batches:
            yield pd.Series(scores([bytes(x) for x in batch], shared.value, words))
        del words
        give_back()

    return docs.withColumn("score", scored(utf8("text")))
