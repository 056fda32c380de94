"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer network with temperature-calibrated probabilities.

Fitting uses a bounded sample of the labelled rows (``max_rows``, the rows of
smallest hash of ``doc_id``, so the choice does not depend on partitioning):

1. words are counted by documents; the ``max_words`` most frequent ones make
   the vocabulary, any other word falls back to its shape (classes of its
   characters), which is a vocabulary entry like a word;
2. every entry has a fixed sparse ternary index vector, drawn from its hash.
   An entry's word vector adds up the index vectors of its neighbours within
   ``WINDOW`` places over the sample (integer sums, so the order of tasks does
   not matter) and its own;
3. a document is the mean and the spread of its word vectors, plus a few
   repetition and length figures;
4. the network (one hidden layer, numpy) is trained on the larger part of the
   sample; one temperature is then fitted on the rest by log loss.

Scoring is one map over all rows, written by the operator itself: a caller's
write would hand a whole split of texts to Python at once. Only the text is an
input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, small_batches, stage, table

DIM = 48
WINDOW = 2
NONZERO = 6
HIDDEN = 32
MAX_ROWS = 8192
MAX_WORDS = 20_000
THRESHOLD = 0.3
SLICES = 8
SLICE_ROWS = 500
COUNTED = 20_000         # entries that a task counts before it hands them on
FIGURES = 5
_TOKEN = re.compile(r"\w+|[^\w\s]+")


@lru_cache(16_384)
def shape(word: str) -> str:
    """The character classes of a word, each run once, and whether it is long."""
    out = []
    for ch in word:
        c = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else "."
        if not out or out[-1] != c:
            out.append(c)
    return "\x00" + "".join(out[:6]) + ("+" if len(word) > 8 else "")


def index_vector(entry: str, dim: int = DIM) -> np.ndarray:
    """The entry's sparse ternary vector."""
    rng = np.random.default_rng(zlib.crc32(entry.encode("utf-8", "surrogatepass")))
    v = np.zeros(dim, dtype=np.int64)
    v[rng.choice(dim, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    return v


class Vocabulary(dict):
    """Entry to row; a word outside it gives its shape's row, else -1."""

    def __missing__(self, word: str) -> int:
        return self.get(shape(word), -1)


def pooled(text: str, vocabulary: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, and repetition and length figures."""
    words = _TOKEN.findall(text)
    rows = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    known = rows[rows >= 0]
    n = len(known)
    out = np.zeros(2 * vectors.shape[1] + FIGURES, dtype=np.float64)
    if n:
        entry, count = np.unique(known, return_counts=True)
        v = vectors[entry]
        share = count / n
        mean = share @ v
        out[:len(mean)] = mean
        out[len(mean):2 * len(mean)] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[-4] = share.max()
        out[-3] = np.log(len(entry)) / np.log(n + 1)
    out[-5] = sum(map(eq, words, words[1:])) / max(1, len(words))
    out[-2] = np.log1p(len(words)) / 8
    out[-1] = np.log1p(len(text) / max(1, len(words))) / 3
    return out


@dataclass
class Classifier:
    vocabulary: Vocabulary
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([pooled(t, self.vocabulary, self.vectors) for t in texts])
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned: crc32 of the id's text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled rows ``(doc_id, text, quality)`` that are
    not held out. The chosen labels are few by that bound, so they are
    broadcast and the documents are not shuffled."""
    chosen = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return id_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])


def _vocabulary(sample: DataFrame, max_words: int) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                   names=["entry", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = set(_TOKEN.findall(text))
                seen.update(words | set(map(shape, words)))
                if len(seen) >= COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    top = (sample.select("text").mapInArrow(count, "entry string, n bigint")
           .groupBy("entry").agg(F.sum("n").alias("n")).where("n >= 3")
           .orderBy(F.desc("n"), "entry").limit(max_words).collect())
    return Vocabulary({r["entry"]: i for i, r in enumerate(top)})


def _word_vectors(sample: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    spark = sample.sparkSession
    index = np.stack([index_vector(e) for e in vocabulary]) if vocabulary else np.zeros((0, DIM), np.int64)
    shared = spark.sparkContext.broadcast((vocabulary, index.astype(np.int8)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, idx = shared.value
        sums = np.zeros((len(voc) + 1, DIM), dtype=np.int32)
        idx = np.vstack([idx, np.zeros((1, DIM), np.int8)]).astype(np.int32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = _TOKEN.findall(text)
                rows = np.fromiter(map(voc.__getitem__, words), np.int64, len(words))
                for d in range(1, min(WINDOW, len(rows) - 1) + 1):
                    np.add.at(sums, rows[:-d], idx[rows[d:]])
                    np.add.at(sums, rows[d:], idx[rows[:-d]])
        yield pa.record_batch([pa.array([sums[:-1].tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((len(vocabulary), DIM), dtype=np.int64)
    for r in sample.select("text").mapInArrow(add, "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"], np.int32).reshape(total.shape)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.maximum(norm, 1e-9) + index / np.sqrt(NONZERO)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int, seed: int = 7):
    """Weights by Adam on log loss, then the temperature of least log loss."""
    rng = np.random.default_rng(seed)
    fit = ~calibrate
    centre, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z, t = (x[fit] - centre) / scale, y[fit].astype(np.float64)
    d = z.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
         np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, size = 0, 64
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(z))
        for at in range(0, len(z), size):
            rows = order[at:at + size]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            e = (_sigmoid(h @ p[2] + p[3]) - t[rows]) / len(rows)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [z[rows].T @ back + 1e-3 * p[0] / len(rows), back.sum(0), h.T @ e, np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if calibrate.any():
        logits = np.maximum((x[calibrate] - centre) / scale @ p[0] + p[1], 0) @ p[2] + p[3]
        c = y[calibrate]
        grid = np.geomspace(0.5, 8, 60)

        def loss(s: float) -> float:
            q = np.clip(_sigmoid(logits / s), 1e-7, 1 - 1e-7)
            return float(-np.mean(c * np.log(q) + (1 - c) * np.log(1 - q)))

        temperature = float(min(grid, key=loss))
    return centre, scale, p, temperature


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS,
        epochs: int = 30) -> Classifier:
    """Fit on a bounded sample of the labelled rows (see the module text).

    Without any usable label, or with labels of one kind only, the network is
    constant: it scores every text with the (smoothed) share of label 1.
    """
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, max_rows, max_words, epochs)


def _fit(docs: DataFrame, labels: DataFrame, max_rows: int, max_words: int, epochs: int) -> Classifier:
    sample = training_sample(docs, labels, max_rows).repartition(SLICES).persist()
    try:
        vocabulary = _vocabulary(sample, max_words)
        vectors = _word_vectors(sample, vocabulary)
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vectors))

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voc, vec = shared.value
            for batch in batches:
                x = [pooled(t, voc, vec).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())],
                                      names=["doc_id", "quality", "x"])

        rows = sample.select("doc_id", "text", "quality").mapInArrow(
            pool, "doc_id bigint, quality int, x binary").collect()
    finally:
        sample.unpersist()
    width = 2 * DIM + FIGURES
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], dtype=np.float64).reshape(len(rows), width)
    y = np.array([1 if r["quality"] else 0 for r in rows])
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        layers = [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([np.log(share / (1 - share))])]
        return Classifier(vocabulary, vectors, np.zeros(width), np.ones(width), layers)
    calibrate = np.array([zlib.crc32(b"calibrate%d" % r["doc_id"]) % 6 == 0 for r in rows])
    if len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    centre, scale, layers, temperature = _train(x, y, calibrate, epochs)
    return Classifier(vocabulary, vectors, centre, scale, layers, temperature)


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A null text is scored as the empty text; a null ``doc_id`` stays null and
    is not held out; repeated rows are scored alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = model.score(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = stage(id_text(docs).mapInArrow(run, "doc_id bigint, score double"), "scored")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns, staged."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            # a worker holds the texts of few rows beside the batch
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                s = model.score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(s >= threshold))

    # mapInArrow looks its columns up by name, which some names do not survive
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return stage(plain.mapInArrow(run, plain.schema), "good").toDF(*names)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text of ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
