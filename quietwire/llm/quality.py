"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

1. *Word vectors.* Words (runs of letters and digits in their case, and runs of other marks) are hashed to ``BUCKETS`` buckets. A bucket's vector is the
   sum of the fixed sparse ternary index vectors of the words next to it, over the whole corpus (random indexing); the sums of all tasks are
   added up per slice of buckets. The vectors are centred and brought to length one.
2. *Pooling.* A document is the mean and the spread of its word vectors, the mean product of neighbours (high in
   repeated text), and the logarithm of its length. Words beyond a group of texts are pooled piece by piece, so any length works.
3. *Network.* One hidden layer, trained with numpy on at most ``SAMPLE`` labelled rows (the lowest hashes of the doc_id). A fifth of them
   is left out of the fit to choose the temperature that makes the probabilities honest.

Labels are read only for training rows (see ``held_out``); language, source, doc_id and labels are never inputs of a score.

Cases: null and empty texts, and texts without words, get the score of an all-zero input; a document with several labels takes their
mean, labels that are null or belong to no document are ignored; with one class or no label at all every score is the smoothed share of label 1;
repeated rows get equal scores; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, written
from quietwire.llm.word_hashes import buffers, groups, mix, words

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
SLICES = 32
SAMPLE = 20_000
HIDDEN = 24
EPOCHS = 60
SEED = 7
FAN_IN = 256
PIECE_WORDS = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def index_vectors(buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each bucket's index vector."""
    draw = mix(np.arange(buckets * NONZERO, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(buckets, NONZERO)
    return (draw % np.uint64(DIMENSIONS)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def bucketed(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = words(raw, bounds, lower=False, marks=True)
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), owner


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context sums of one task, as (slice, part, sums) rows."""
    from pyspark import TaskContext

    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    any_rows = False
    for batch in batches:
        raw, bounds = buffers(batch.column(0))
        for first, end in groups(bounds):
            bucket, owner = bucketed(raw, bounds[first:end + 1])
            beside = owner[1:] == owner[:-1]
            left, right = bucket[:-1][beside], bucket[1:][beside]
            any_rows = any_rows or len(left) > 0
            for word, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    total += np.bincount(word * DIMENSIONS + places[other, k], weights=signs[other, k], minlength=len(total))
    if any_rows:
        pieces = list(total.reshape(SLICES, -1))
        part = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["slice", "part", "sums"])


def _added(held: pd.DataFrame) -> pd.DataFrame:
    """The sum of the rows of one group (whole numbers, so any order gives the same)."""
    total = np.zeros(BUCKETS * DIMENSIONS // SLICES)
    for sums in held["sums"]:
        total += sums
    return pd.DataFrame({"slice": held["slice"].iloc[:1], "part": held["part"].iloc[:1], "sums": [total]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets: a table of fixed size (``BUCKETS`` x ``DIMENSIONS``), whatever the corpus."""
    schema = "slice int, part int, sums array<double>"
    partial = documents_of(docs).select("text").mapInArrow(_context_sums, schema)
    near = partial.groupBy("slice", "part").applyInPandas(_added, schema)
    vectors = np.zeros((SLICES, BUCKETS * DIMENSIONS // SLICES))
    for row in near.groupBy("slice").applyInPandas(_added, schema).collect():  # SLICES rows
        vectors[row.slice] = row.sums
    vectors = vectors.reshape(BUCKETS, DIMENSIONS)
    used = np.abs(vectors).sum(axis=1) > 0
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(length, 1e-9)
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32)


def pooled(bucket: np.ndarray, owner: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """Features of ``n`` texts from the buckets of their words."""
    width = vectors.shape[1]
    sums, squares, beside, count = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n), np.bincount(owner, minlength=n)
    for at in range(0, len(bucket), PIECE_WORDS):
        end = min(len(bucket), at + PIECE_WORDS)
        held, mine = vectors[bucket[at:end]], owner[at:end]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        sums[mine[first]] += np.add.reduceat(held, first)
        squares[mine[first]] += np.add.reduceat(held * held, first)
        before = max(at - 1, 0)
        pair = owner[before + 1:end] == owner[before:end - 1]
        if before < at:
            held = np.concatenate([vectors[bucket[before:at]], held])
        products = np.einsum("ij,ij->i", held[1:], held[:-1]) * pair
        beside += np.bincount(owner[before + 1:end], weights=products, minlength=n)
    mean = sums / np.maximum(count, 1)[:, None]
    spread = np.sqrt(np.maximum(squares / np.maximum(count, 1)[:, None] - mean * mean, 0))
    return np.column_stack([mean, spread, beside / np.maximum(count - 1, 1), np.log1p(count)]).astype(np.float32)


def document_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and its pooled features."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = 2 * table.shape[1] + 2
        for batch in batches:
            raw, bounds = buffers(batch.column(1))
            for first, end in groups(bounds, 1 << 19):
                rows = pooled(*bucketed(raw, bounds[first:end + 1]), end - first, table)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), made], names=["doc_id", "features"])

    return documents_of(docs).mapInArrow(run, "doc_id long, features array<float>")


@dataclass(frozen=True)
class Network:
    """A two-layer network over standardised features; probabilities are divided by ``temperature`` in the logit."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))


def _log_loss(logits: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - label * logits))


def fit(features: np.ndarray, label: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on the log loss in small batches; every fifth row is kept for the temperature."""
    n, width = features.shape if features.size else (0, 2 * DIMENSIONS + 2)
    if n == 0 or label.min() == label.max():
        share = (label.sum() + 1) / (n + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(SEED)
    apart = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    x, y = features[~apart].astype(np.float64), label[~apart]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    weights = [rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows, step = order[at:at + 256], step + 1
            inner = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - inner * inner)
            slopes = [x[rows].T @ back + 1e-5 * weights[0], back.sum(axis=0), inner.T @ error + 1e-5 * weights[2], error.sum(keepdims=True)]
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    network = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if not apart.any():
        return network
    logits = network.logits(features[apart])
    best = min(np.geomspace(0.25, 8, 61), key=lambda t: _log_loss(logits / t, label[apart]))
    return Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), float(best))


def training_rows(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """About ``sample`` labelled rows that are not held out: those with the lowest hashes of the doc_id."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.avg(F.col("quality").cast("double")).alias("label"))
    total = known.count()
    cut = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    rows = features.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("features").alias("features"), F.first("label").alias("label")).toPandas()
    rows = rows.sort_values("doc_id")
    return np.array(rows["features"].tolist(), np.float64).reshape(len(rows), 2 * DIMENSIONS + 2), rows["label"].to_numpy(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 is likelier), predicted."""
    features = written(document_features(docs, word_vectors(docs)), "features")
    network = fit(*training_rows(features, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.probability(values))], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns. Rows of one doc_id stay or go by their mean score."""
    rejected = (quality_scores(docs, labels).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("score").alias("_score")).where("_score < 0.5"))
    return docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(rejected["_id"]), "left_anti")
