"""Multiclass gradient boosting over histograms (K10): one regression tree per class and round, all classes of a level in one pass.

1. Cut points of every feature are quantiles; rows are binned once and stored in blocks (labels, bins and class scores of one Arrow batch in a row).
2. A level adds up gradients and Hessians of the softmax loss by (class, node, feature, bin). The sums of a (class, node) meet in one task, which
   finds the best split; the driver gets one row for each split, not the sums.
3. Scores are stored anew every ``REFRESH`` rounds; in between a pass adds the trees of the rounds since.

A pass is one shuffle of the sums of the stored blocks. Blocks are read through the RDD of the stored table, as a pass is imperative code per block and is planned once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwire.session import cut_lineage

REFRESH = 10
NODE_TABLE = "round int, class string, node int, feature int, threshold double, left int, right int, value double"


@dataclass(frozen=True)
class Boosting:
    """Parameters of an ensemble; ``penalty`` shrinks leaves, ``least`` is the least Hessian sum of a child."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    bins: int = 32
    penalty: float = 1.0
    least: float = 1.0


@dataclass(frozen=True)
class Trees:
    """One tree for each class as arrays over heap numbers (children of i: 2i+1, 2i+2); feature -1 is a leaf; the left child has bins up to ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row and class after ``levels`` decisions."""
        rows, classes = np.arange(len(bins))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(bins), len(self.feature)), np.int64)
        for _ in range(levels):
            feature = self.feature[classes, at]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[classes, at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[np.arange(len(self.feature))[None, :], self.places(bins, depth)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many cut points lie at or below a value; a missing value is in the first bin."""
    if not cuts:
        return np.zeros((len(x), 0), np.uint8)
    return np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], side="right")) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 quantiles of every entry of ``x``."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    entry = rows.select(F.posexplode("x").alias("f", "v")).where("v is not null and not isnan(v)")
    found = {r.f: np.unique(r.q) for r in entry.groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return [np.asarray(found.get(f, []), float) for f in range(size)]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], classes: list[str]) -> DataFrame:
    number = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
                y = np.array([number[c] for c in batch.column(1).to_pylist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([binned(x, cuts).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()),
                                                  pa.array([np.zeros((len(y), len(classes))).tobytes()], pa.binary())], names=["bins", "y", "scores"])

    return cut_lineage(rows.where(F.col("y").isin(classes)).select("x", "y").mapInArrow(run, "bins binary, y binary, scores binary"))


def _refreshed(blocks: DataFrame, recent: list[Trees], depth: int, n_classes: int, n_features: int) -> DataFrame:
    """The blocks with the scores of ``recent`` trees added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, y, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                bins = np.frombuffer(b, np.uint8).reshape(-1, n_features)
                scores = np.frombuffer(s).reshape(-1, n_classes) + sum(t.scores(bins, depth) for t in recent)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (b, y, scores.tobytes())], names=["bins", "y", "scores"])

    return cut_lineage(blocks.mapInArrow(run, blocks.schema))


def _level_sums(block, recent: list[Trees], trees: Trees, level: int, depth: int, n_bins: int, n_features: int) -> np.ndarray:
    """(2, class, node of the level, feature, bin): sums of gradients and Hessians of one block."""
    n_classes = len(trees.feature)
    bins = np.frombuffer(block["bins"], np.uint8).reshape(-1, n_features)
    y = np.frombuffer(block["y"], np.int32)
    scores = np.frombuffer(block["scores"]).reshape(-1, n_classes) + sum((t.scores(bins, depth) for t in recent), 0.0)
    p = _softmax(scores)
    gradient, hessian = p - (y[:, None] == np.arange(n_classes)), p * (1 - p)
    at = trees.places(bins, level) - (2 ** level - 1)  # below zero: the row has come to a leaf already
    shape = (2 ** level, n_features, n_bins)
    out = np.zeros((2, n_classes, int(np.prod(shape))))
    for c in range(n_classes):
        live = at[:, c] >= 0
        cell = ((at[live, c][:, None] * n_features + np.arange(n_features)) * n_bins + bins[live]).ravel()
        for i, weight in enumerate((gradient, hessian)):
            out[i, c] = np.bincount(cell, weights=np.repeat(weight[live, c], n_features), minlength=out.shape[2])
    return out.reshape(2, n_classes, *shape)


def _node_sums(blocks: Iterator, recent: list[Trees], trees: Trees, level: int, depth: int, n_bins: int, n_features: int) -> Iterator[tuple]:
    """((class, node of the level), sums by (2, feature, bin)) of all blocks of a task, for nodes that rows have come to."""
    total = None
    for block in blocks:
        part = _level_sums(block, recent, trees, level, depth, n_bins, n_features)
        total = part if total is None else total + part
    if total is not None:
        for c, node in np.argwhere(total.any(axis=(0, 3, 4))):
            yield (int(c), int(node)), total[:, c, node].copy()


def _best_split(key: tuple[int, int], sums: np.ndarray, p: Boosting) -> tuple | None:
    """(class, node, feature, cut, value of the left child, value of the right child) of the best split of a node, if one gains anything."""
    left = np.cumsum(sums, axis=-1)[..., :-1]
    total = sums.sum(axis=-1)[..., :1, None]  # the same for every feature
    right = total - left
    quality = lambda s: s[0] ** 2 / (s[1] + p.penalty)
    gain = np.where((left[1] >= p.least) & (right[1] >= p.least), quality(left) + quality(right) - quality(total), -np.inf)
    if gain.size == 0 or not gain.max() > 1e-10:
        return None
    feature, cut = divmod(int(gain.argmax()), gain.shape[-1])
    values = [float(-p.rate * g / (h + p.penalty)) for g, h in (side[:, feature, cut] for side in (left, right))]
    return (*key, feature, cut, *values)


def _split(trees: Trees, splits: list[tuple], level: int) -> bool:
    """Writes the best splits of a level and the values of its nodes' children into ``trees``; whether there is a split."""
    for c, node, feature, cut, low, high in splits:
        at = 2 ** level - 1 + node
        trees.feature[c, at], trees.cut[c, at] = feature, cut
        trees.value[c, 2 * at + 1], trees.value[c, 2 * at + 2] = low, high
    return bool(splits)


@dataclass
class BoostedModel:
    """Fitted ensembles: class names, cut points of the features and the trees of every round."""

    classes: list[str]
    cuts: list[np.ndarray]
    rounds: list[Trees]
    depth: int

    def node_table(self, spark) -> DataFrame:
        """All nodes as rows: a value below ``threshold`` (or a missing one) goes left; a leaf has no feature."""
        rows = []
        for r, t in enumerate(self.rounds):
            for c, name in enumerate(self.classes):
                open_ = [0]
                for at in open_:  # grows meanwhile
                    f = int(t.feature[c, at])
                    if f < 0:
                        rows.append((r, name, at, None, None, None, None, float(t.value[c, at])))
                    else:
                        rows.append((r, name, at, f, float(self.cuts[f][t.cut[c, at]]), 2 * at + 1, 2 * at + 2, None))
                        open_ += [2 * at + 1, 2 * at + 2]
        return spark.createDataFrame(rows, NODE_TABLE)

    def margins(self, column):
        """The sums of the trees' values for each class as an array column, for an array<double> column."""
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack([np.asarray(v, float) for v in batch]) if len(batch) else np.zeros((0, len(model.cuts)))
                bins = binned(x.reshape(len(batch), -1), model.cuts)
                total = np.zeros((len(x), len(model.classes)))
                for t in model.rounds:
                    total += t.scores(bins, model.depth)
                yield pd.Series(list(total))

        return scored(column)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction``, ``pred``, ``scores`` and ``confidence``; ties go to the first class."""
        names = F.array(*[F.lit(c) for c in self.classes]).cast("array<string>")
        out = rows.withColumn("_margin", self.margins(vector_to_array("features")))
        top = F.array_max("_margin")
        powers = F.transform("_margin", lambda v: F.exp(v - top))
        share = F.transform("_powers", lambda v: v / F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("prediction", (F.array_position("_margin", top) - 1).cast("double")).withColumn("_powers", powers)
        out = out.withColumn("pred", F.get(names, F.col("prediction").cast("int"))).withColumn("scores", F.map_from_arrays(names, share))
        return out.withColumn("confidence", F.try_element_at("scores", F.col("pred"))).drop("_margin", "_powers")


def fit_boosted(rows: DataFrame, label: str, p: Boosting = Boosting()) -> BoostedModel:
    """``rows`` carries ``features`` and ``label``; rows without a label do not take part."""
    plain = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("string").alias("y")).where("y is not null")
    classes = sorted(r.y for r in plain.select("y").distinct().collect())
    cuts = cut_points(plain, p.bins)
    blocks = _blocks(plain, cuts, classes)
    context, source = blocks.sparkSession.sparkContext, blocks.rdd
    nodes, rounds, recent = 2 ** (p.depth + 1) - 1, [], []
    for _ in range(p.rounds if len(classes) > 1 else 0):
        trees = Trees(np.full((len(classes), nodes), -1), np.zeros((len(classes), nodes), np.int64), np.zeros((len(classes), nodes)))
        for level in range(p.depth):
            state = context.broadcast((recent, trees))
            n_bins, n_features, depth = p.bins, len(cuts), p.depth

            def sums(blocks, state=state, level=level, n_bins=n_bins, n_features=n_features, depth=depth):
                return _node_sums(blocks, *state.value, level, depth, n_bins, n_features)

            tasks = max(1, min(source.getNumPartitions(), len(classes) * 2 ** level))
            best = source.mapPartitions(sums).reduceByKey(np.add, tasks).map(lambda node: _best_split(*node, p)).filter(lambda split: split is not None)
            found = _split(trees, best.collect(), level)
            state.destroy()
            if not found:
                break
        rounds.append(trees)
        recent = [*recent, trees]
        if len(recent) == REFRESH:
            blocks = _refreshed(blocks, recent, p.depth, len(classes), len(cuts))
            source, recent = blocks.rdd, []
    return BoostedModel(classes, cuts, rounds, p.depth)
