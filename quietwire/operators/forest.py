"""Random forest over histograms (K9): bootstrap samples, a square root of the features for each node, Gini impurity; the trees never pass through the driver.

1. Rows are binned once and stored in blocks. A tree's weight of a row is a Poisson draw that belongs to (seed, tree, block), a node's features belong to (seed, tree, node).
2. Nodes of more than ``LOCAL`` rows are split level by level: blocks add up class counts by (tree, node, feature, bin), a node's sums meet in one task, and the driver
   gets one row for each split. There are about rows / ``LOCAL`` such nodes in a tree.
3. The rows of any other node move to one task, which grows the subtree. Subtrees are stored; scoring brings rows to trees, ``GROUPS`` groups of them, and adds up their votes.

A sum of weights is a whole number, so a tree does not depend on where it was grown.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.operators.boosting import binned, cut_points
from quietwire.session import cut_lineage

#: Rows (as drawn) that one task takes for a node, class counts that are held at once, groups of trees and rows that are scored together.
LOCAL, CELLS, GROUPS, SLICE = 1 << 18, 1 << 21, 10, 1 << 16
BLOCKS = "part int, number int, size int, bins binary, y binary"
BAGGED = "tree int, node long, bins binary, y binary, weight binary"
SUBTREES = "tree int, number binary, feature binary, cut binary, counts binary"


@dataclass(frozen=True)
class Forest:
    """Parameters of a forest."""

    trees: int = 100
    depth: int = 16
    seed: int = 42
    bins: int = 32

    def getNumTrees(self) -> int:
        return self.trees

    def getMaxDepth(self) -> int:
        return self.depth

    def chosen(self, features: int) -> int:
        """How many features a node looks at."""
        return features if self.trees == 1 else int(np.ceil(np.sqrt(features)))


@dataclass(frozen=True)
class _Shape:
    """What a task needs besides rows: parameters and the numbers of features and classes."""

    p: Forest
    features: int
    classes: int

    def weights(self, tree: int, part: int, number: int, size: int) -> np.ndarray:
        draws = np.random.default_rng([self.p.seed & 0xFFFFFFFF, tree, part, number]).poisson(1.0, size)
        return np.minimum(draws, 255).astype(np.uint8)

    def choice(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        """(node, chosen feature): those with the least hashes."""
        start = np.random.default_rng([self.p.seed & 0xFFFFFFFF, tree]).integers(1 << 63, dtype=np.uint64)
        z = nodes.astype(np.uint64)[:, None] * np.uint64(self.features) + np.arange(1, self.features + 1, dtype=np.uint64)
        z = z * np.uint64(0x9E3779B97F4A7C15) + start
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
        z ^= z >> np.uint64(31)
        k = self.p.chosen(self.features)
        return np.sort(np.argsort(z, axis=1)[:, :k], axis=1)

    def sums(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """(node, chosen feature, bin, class): sums of the weights of rows in node number ``at``."""
        n, k = chosen.shape
        cell = bins[np.arange(len(at))[:, None], chosen[at]].astype(np.int64)
        cell += (at[:, None] * k + np.arange(k)) * self.p.bins
        cell *= self.classes
        cell += y[:, None]
        size = n * k * self.p.bins * self.classes
        return np.bincount(cell.ravel(), weights=np.repeat(weight, k), minlength=size).reshape(n, k, self.p.bins, self.classes)


def _best(sums: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, class counts of the left child) of every node; the feature is -1 where no split lessens the impurity."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    n, whole = total.sum(axis=1), (total ** 2).sum(axis=1)
    low = left.sum(axis=-1)
    high = n[:, None, None] - low
    own = np.einsum("nfbc,nfbc->nfb", left, left)
    rest = whole[:, None, None] - 2 * np.einsum("nfbc,nc->nfb", left, total) + own
    quality = np.where((low > 0) & (high > 0), own / np.maximum(low, 1) + rest / np.maximum(high, 1), -np.inf).reshape(len(sums), -1)
    place = quality.argmax(axis=1)
    gains = quality.max(axis=1) - whole / np.maximum(n, 1) > 1e-9 * n
    f, cut = np.divmod(place, left.shape[2])
    every = np.arange(len(sums))
    return np.where(gains, chosen[every, f], -1), cut, left[every, f, cut]


def _grown(shape: _Shape, tree: int, root: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, feature, cut) of the nodes below and with ``root`` by number, and the class counts of the leaves among them. All nodes of a level at once."""
    classes, at, numbers = shape.classes, np.zeros(len(y), np.int64), np.array([root], np.int64)
    level, found, ends = int(root + 1).bit_length() - 1, [], []
    cells = max(1, CELLS // (shape.p.chosen(shape.features) * shape.p.bins * classes))
    while len(numbers):
        counts = np.bincount(at * classes + y, weights=weight, minlength=len(numbers) * classes).reshape(-1, classes)
        feature, cut = np.full(len(numbers), -1), np.zeros(len(numbers), np.int64)
        open_ = np.flatnonzero(counts.max(axis=1) < counts.sum(axis=1)) if level < shape.p.depth and shape.features else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(numbers) + 1))
        place = np.zeros(len(numbers), np.int64)
        for some in (open_[i:i + cells] for i in range(0, len(open_), cells)):
            rows = order[edges[some[0]]:edges[some[-1] + 1]]
            taken = np.zeros(len(numbers), bool)
            taken[some] = True
            rows = rows[taken[at[rows]]]
            place[some] = np.arange(len(some))
            chosen = shape.choice(tree, numbers[some])
            feature[some], cut[some], _ = _best(shape.sums(bins[rows], y[rows], weight[rows], place[at[rows]], chosen), chosen)
        found.append((numbers, feature, cut))
        ends.append(counts[feature < 0])
        split = feature >= 0
        rank = np.cumsum(split) - 1
        moved = split[at]
        bins, y, weight, at = bins[moved], y[moved], weight[moved], at[moved]
        at = 2 * rank[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        numbers = (2 * numbers[split][:, None] + np.array([1, 2])).ravel()
        level += 1
    number, feature, cut = (np.concatenate(parts) for parts in zip(*found))
    return number, feature.astype(np.int32), cut.astype(np.uint8), np.concatenate(ends)


@dataclass(frozen=True)
class _Tree:
    """Nodes by number (children of n: 2n+1, 2n+2, which follow one another); feature -1 is a leaf or a node still to be grown."""

    number: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(number: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> _Tree:
        order = np.argsort(number)
        number = number[order]
        return _Tree(number, feature[order], cut[order], np.searchsorted(number, 2 * number + 1))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The place among the nodes at which each row ends."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.feature[here]] > self.cut[here])
        return at


def _blocks(rows: DataFrame, cuts: list[np.ndarray], classes: list[str | None]) -> DataFrame:
    number = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(b for b in batches if b.num_rows):
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            y = np.array([number[c] for c in batch.column(1).to_pylist()], np.int32)
            yield pa.RecordBatch.from_pylist([{"part": part, "number": i, "size": len(y), "bins": binned(x, cuts).tobytes(), "y": y.tobytes()}],
                                             pa.schema([("part", pa.int32()), ("number", pa.int32()), ("size", pa.int32()), ("bins", pa.binary()), ("y", pa.binary())]))

    return cut_lineage(rows.select("x", "y").mapInArrow(run, BLOCKS))


def _node_sums(blocks: Iterator, shape: _Shape, tops: dict[int, _Tree], wanted: list[tuple[int, int]]) -> Iterator[tuple]:
    """((tree, node), sums by (chosen feature, bin, class)) of all blocks of a task, for the nodes ``wanted``."""
    total: dict[int, np.ndarray] = {}
    nodes = {t: np.array(sorted(n for u, n in wanted if u == t)) for t in {t for t, _ in wanted}}
    chosen = {t: shape.choice(t, n) for t, n in nodes.items()}
    for b in blocks:
        bins, y = np.frombuffer(b["bins"], np.uint8).reshape(b["size"], -1), np.frombuffer(b["y"], np.int32)
        for t, numbers in nodes.items():
            weight = shape.weights(t, b["part"], b["number"], b["size"])
            here = tops[t].number[tops[t].places(bins)]
            at = np.minimum(np.searchsorted(numbers, here), len(numbers) - 1)
            rows = np.flatnonzero((weight > 0) & (numbers[at] == here))
            if len(rows):
                part = shape.sums(bins[rows], y[rows], weight[rows], at[rows], chosen[t])
                total[t] = total[t] + part if t in total else part
    for t, sums in total.items():
        for i, n in enumerate(nodes[t]):
            yield (t, int(n)), sums[i]


def _top(blocks: DataFrame, shape: _Shape, rows: int) -> tuple[dict[int, _Tree], list[tuple]]:
    """The trees as far as their nodes have more than ``LOCAL`` rows, and the (tree, number, class counts) of leaves among those."""
    nodes, leaves = {t: {0: (-1, 0)} for t in range(shape.p.trees)}, []
    trees = lambda: {t: _Tree.of(np.array([*n], np.int64), *np.array([*n.values()], np.int64).T) for t, n in nodes.items()}
    wanted = [(t, 0) for t in nodes] if rows > LOCAL and shape.p.depth and shape.features else []
    context, source = blocks.sparkSession.sparkContext, blocks.rdd
    most = max(1, 16 * CELLS // (shape.p.chosen(shape.features) * shape.p.bins * shape.classes)) if shape.features else 1
    while wanted:
        tops, following = context.broadcast(trees()), []
        for some in (wanted[i:i + most] for i in range(0, len(wanted), most)):

            def sums(found, tops=tops, some=some):
                return _node_sums(found, shape, tops.value, some)

            def best(item):
                (tree, node), cells = item
                chosen = shape.choice(tree, np.array([node]))
                feature, cut, low = _best(cells[None], chosen)
                counts = cells[0].sum(axis=0)
                return tree, node, int(feature[0]), int(cut[0]), low[0].tolist(), (counts - low[0]).tolist(), counts.tolist()

            tasks = max(1, min(source.getNumPartitions(), len(some)))
            for tree, node, feature, cut, low, high, counts in source.mapPartitions(sums).reduceByKey(np.add, tasks).map(best).collect():
                if feature < 0:
                    leaves.append((tree, node, counts))
                    continue
                nodes[tree][node] = feature, cut
                for child, own in ((2 * node + 1, low), (2 * node + 2, high)):
                    nodes[tree][child] = -1, 0
                    last = child + 1 >= 1 << shape.p.depth or max(own) == sum(own)
                    if last:
                        leaves.append((tree, child, own))
                    elif sum(own) > LOCAL:
                        following.append((tree, child))
        tops.destroy()
        wanted = following
    return trees(), leaves


def _packed(tree: int, number: np.ndarray, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> dict:
    return {"tree": tree, "number": number.astype(np.int64).tobytes(), "feature": feature.astype(np.int32).tobytes(), "cut": cut.astype(np.uint8).tobytes(),
            "counts": counts.astype(float).tobytes()}


_SUBTREE = pa.schema([("tree", pa.int32()), *[(n, pa.binary()) for n in ("number", "feature", "cut", "counts")]])


def _subtrees(blocks: DataFrame, shape: _Shape, tops: dict[int, _Tree], leaves: list[tuple]) -> DataFrame:
    """All trees in parts: what the driver knows of their tops, and the subtrees grown in tasks."""
    spark, ends = blocks.sparkSession, {}
    for tree, node, counts in leaves:
        ends.setdefault(tree, {})[node] = counts
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("bins", pa.binary()), ("y", pa.binary()), ("weight", pa.binary())])
    final = {t: np.array(sorted(found), np.int64) for t, found in ends.items()}
    none = np.zeros(0, np.int64)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                bins, y = np.frombuffer(b["bins"], np.uint8).reshape(b["size"], -1), np.frombuffer(b["y"], np.int32)
                for t, top in tops.items():
                    weight = shape.weights(t, b["part"], b["number"], b["size"])
                    here = top.number[top.places(bins)]
                    drawn = np.flatnonzero((weight > 0) & ~np.isin(here, final.get(t, none)))
                    drawn = drawn[np.argsort(here[drawn], kind="stable")]
                    numbers, starts = np.unique(here[drawn], return_index=True)
                    if len(drawn):
                        yield pa.RecordBatch.from_pylist([{"tree": t, "node": int(n), "bins": bins[r].tobytes(), "y": y[r].tobytes(), "weight": weight[r].tobytes()}
                                                          for n, r in zip(numbers, np.split(drawn, starts[1:]))], schema)

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        tree, root = (k.as_py() for k in key)
        whole = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        y = whole("y", np.int32)
        grown = _grown(shape, tree, root, whole("bins", np.uint8).reshape(len(y), -1), y, whole("weight", np.uint8))
        return pa.Table.from_pylist([_packed(tree, *grown)], _SUBTREE)

    parts = sum(len(t.number) for t in tops.values())
    moved = blocks.mapInArrow(bagged, BAGGED).repartition(max(1, min(parts, 4 * spark.sparkContext.defaultParallelism + shape.p.trees)), "tree", "node")
    grown = moved.groupBy("tree", "node").applyInArrow(grow, SUBTREES)
    known = []
    for t, top in tops.items():
        last = final.get(t, none)
        own = (top.feature >= 0) | np.isin(top.number, last)
        if own.any():
            number, feature, cut = top.number[own], top.feature[own], top.cut[own]
            known.append(_packed(t, number, feature, cut, np.array([ends[t][n] for n in number[feature < 0].tolist()], float)))
    return cut_lineage(grown.unionByName(spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r.values()) for r in known], SUBTREES)) if known else grown)


@dataclass
class ForestModel:
    """A fitted forest: class names (null is the class of rows without a label), cut points of the features, and the trees as a stored table."""

    classes: list[str | None]
    cuts: list[np.ndarray]
    trees: DataFrame

    def votes(self, rows: DataFrame, column, key: str) -> DataFrame:
        """(key, votes): the sums over the trees of the class shares in a row's leaf. Rows come to each group of trees in slices."""
        cuts, n_classes = self.cuts, len(self.classes)
        slices = max(1, -(-rows.count() // SLICE))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for i, batch in enumerate(b for b in batches if b.num_rows):
                x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                bins, keys = binned(x, cuts).tobytes(), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([(part * 7919 + i) % slices], pa.int32()), pa.array([keys], pa.binary()), pa.array([bins], pa.binary())], names=["slice", "keys", "bins"])

        def vote(found: pa.Table, trees: pa.Table) -> pa.Table:
            out, parts = [], {}
            for t in trees.select(["tree", "number", "feature", "cut", "counts"]).to_pylist():
                own = [np.frombuffer(t[n], kind) for n, kind in (("number", np.int64), ("feature", np.int32), ("cut", np.uint8))]
                parts.setdefault(t["tree"], []).append((*own, np.frombuffer(t["counts"]).reshape(-1, n_classes)))
            packed = []
            for _, some in sorted(parts.items()):
                number, feature, cut, counts = (np.concatenate(v) for v in zip(*some))
                tree = _Tree.of(number, feature, cut)
                ends = counts[np.argsort(number[feature < 0])]
                packed.append((tree, np.cumsum(tree.feature < 0) - 1, ends / ends.sum(axis=1, keepdims=True)))
            for b in found.select(["keys", "bins"]).to_pylist():
                keys = np.frombuffer(b["keys"], np.int64)
                bins, total = np.frombuffer(b["bins"], np.uint8).reshape(len(keys), -1), np.zeros((len(keys), n_classes))
                for tree, leaf, shares in packed:
                    total += shares[leaf[tree.places(bins)]]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * n_classes, pa.int32()), pa.array(total.ravel()))
                out.append(pa.table({key: pa.array(keys), "votes": values}))
            return pa.concat_tables(out) if out else pa.table({key: pa.array([], pa.int64()), "votes": pa.array([], pa.list_(pa.float64()))})

        told = rows.select(key, column.alias("x")).mapInArrow(blocks, "slice int, keys binary, bins binary")
        told = told.select("slice", "keys", "bins", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"))
        held = self.trees.select("*", (F.col("tree") % GROUPS).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        tasks = GROUPS * slices
        sides = [df.repartition(tasks, "group", "slice").groupBy("group", "slice") for df in (told, held)]
        each = sides[0].cogroup(sides[1]).applyInArrow(vote, f"{key} long, votes array<double>")
        return each.groupBy(key).agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(n_classes)]).alias("votes"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction``, ``pred``, ``scores`` and ``confidence``; ties go to the first class. The rows are stored once."""
        kept = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
        out = kept.join(self.votes(kept, vector_to_array("features"), "_row"), "_row").drop("_row")
        names, known = F.array(*[F.lit(c) for c in self.classes]).cast("array<string>"), [c for c in self.classes if c is not None]
        out = out.withColumn("prediction", (F.array_position("votes", F.array_max("votes")) - 1).cast("double"))
        sum_ = F.aggregate("votes", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("_shares", F.transform("votes", lambda v: v / sum_)).withColumn("pred", F.get(names, F.col("prediction").cast("int")))
        scores = F.map_from_arrays(F.array(*[F.lit(c) for c in known]).cast("array<string>"), F.slice("_shares", 1, len(known)))
        return out.withColumn("scores", scores).withColumn("confidence", F.try_element_at("scores", F.col("pred"))).drop("votes", "_shares")

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        facts = json.dumps({"classes": self.classes, "cuts": [c.tolist() for c in self.cuts]})
        self.trees.sparkSession.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @staticmethod
    def load(spark, path: str) -> ForestModel:
        facts = json.loads(spark.read.text(f"{path}/forest").first().value)
        return ForestModel(facts["classes"], [np.asarray(c, float) for c in facts["cuts"]], spark.read.schema(SUBTREES).parquet(f"{path}/trees").hint("merge"))


def fit_forest(rows: DataFrame, label: str, p: Forest = Forest()) -> ForestModel:
    """``rows`` carries ``features`` and ``label``; rows without a label are a class of their own."""
    plain = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("string").alias("y"))
    classes = sorted((r.y for r in plain.select("y").distinct().collect()), key=lambda c: (c is None, c))
    cuts = cut_points(plain, p.bins)
    shape, blocks = _Shape(p, len(cuts), len(classes)), _blocks(plain, cuts, classes)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    if not size:
        raise ValueError("a forest needs rows")
    return ForestModel(classes, cuts, _subtrees(blocks, shape, *_top(blocks, shape, size)))
