"""Random forests against a walk of their stored nodes, a plain search, other places of growth, and odd rows."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.operators import forest as R
from quietwire.operators import models as M


def cloud(spark, n=240, parts=3, apart=1.2):
    rng = np.random.default_rng(8)
    rows = [(i, f"c{i % 3}", [float(v) for v in rng.normal(apart * (i % 3), 1, 6)]) for i in range(n)]
    return M.vectors(spark.createDataFrame(rows, "row_id long, y string, x array<double>").coalesce(1).repartition(parts), ["x"])


def nodes_of(model):
    """{tree: {number: (feature, cut) or class counts}}"""
    trees = {}
    for t in model.trees.collect():
        number, feature, cut = (np.frombuffer(t[n], kind) for n, kind in (("number", np.int64), ("feature", np.int32), ("cut", np.uint8)))
        counts = iter(np.frombuffer(t.counts).reshape(-1, len(model.classes)).tolist())
        own = {int(n): (int(f), int(c)) if f >= 0 else tuple(next(counts)) for n, f, c in zip(number, feature, cut)}
        assert not set(own) & set(trees.setdefault(t.tree, {}))
        trees[t.tree] |= own
    return trees


def walked(model, trees, x):
    votes = np.zeros(len(model.classes))
    bins = R.binned(np.array([x]), model.cuts)[0]
    for nodes in trees.values():
        at, level = 0, 0
        while isinstance(nodes[at][0], int) and len(nodes[at]) == 2:
            f, cut = nodes[at]
            at, level = 2 * at + 1 + int(bins[f] > cut), level + 1
        votes += np.array(nodes[at]) / sum(nodes[at])
    return votes / votes.sum()


def test_predictions_equal_a_walk_of_the_stored_nodes(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 50)
    rows = cloud(spark)
    model = M.fit_classifier(rows, "y", M.random_forest(12, 5))
    trees, got = nodes_of(model), M.predict(model, rows).collect()
    assert len(trees) == 12 and max(max(t) for t in trees.values()) < 2 ** 6 - 1 and len(got) == 240
    for r in got:
        want = walked(model, trees, r.x)
        assert [r.scores[c] for c in model.classes] == pytest.approx(want.tolist())
        assert r.pred == model.classes[int(want.argmax())] and r.confidence == pytest.approx(want.max())
    assert sum(r.pred == r.y for r in got) > 200


def test_trees_do_not_depend_on_where_they_grow(spark, monkeypatch):
    """Levels over all rows, subtrees of few rows and whole trees in one task give the same nodes."""
    rows = cloud(spark, apart=0.3).localCheckpoint()
    grown = []
    for local in (1, 30, 10 ** 6):
        monkeypatch.setattr(R, "LOCAL", local)
        grown.append(nodes_of(M.fit_classifier(rows, "y", M.random_forest(4, 6, 7))))
    assert grown[0] == grown[1] == grown[2] and sum(map(len, grown[0].values())) > 100
    assert grown[0] != nodes_of(M.fit_classifier(rows, "y", M.random_forest(4, 6, 8)))


def test_first_split_against_a_plain_search():
    rng = np.random.default_rng(3)
    bins, y, weight = rng.integers(0, 8, (90, 5)).astype(np.uint8), rng.integers(0, 3, 90), rng.poisson(1, 90).astype(np.uint8)
    shape = R._Shape(R.Forest(9, 1, 4), 5, 3)
    number, feature, cut, counts = R._grown(shape, 2, 0, bins, y, weight)

    def impurity(rows):
        n = np.bincount(y[rows], weights=weight[rows], minlength=3)
        return n.sum() - (n ** 2).sum() / n.sum() if n.sum() else np.inf

    chosen = shape.choice(2, np.array([0]))[0]
    cost = lambda f, c: impurity(bins[:, f] <= c) + impurity(bins[:, f] > c)
    assert len(set(chosen)) == 3 and feature[0] in chosen
    assert cost(feature[0], cut[0]) == pytest.approx(min(cost(f, c) for f in chosen for c in range(7)))
    assert counts[0].tolist() == np.bincount(y[bins[:, feature[0]] <= cut[0]], weights=weight[bins[:, feature[0]] <= cut[0]], minlength=3).tolist()


def test_chosen_features_of_nodes_are_even():
    chosen = R._Shape(R.Forest(seed=1), 64, 2).choice(5, np.arange(4000))
    assert all(len(set(c)) == 8 for c in chosen[:50].tolist())
    assert np.abs(np.bincount(chosen.ravel(), minlength=64) - 500).max() < 110


def test_missing_values_one_class_no_rows_and_no_label(spark):
    rows = M.vectors(spark.createDataFrame([(i, "a" if i % 2 else None, [float("nan") if i % 3 == 0 else float(i), float(i % 2)]) for i in range(60)],
                                           "row_id long, y string, x array<double>"), ["x"])
    model = M.fit_classifier(rows, "y", M.random_forest(9, 3))
    out = M.predict(model, rows)
    assert out.filter("y = pred").count() == 30 and out.filter("pred is null").count() == 30 and set(out.first().scores) == {"a"}
    assert M.predict(model, rows.limit(0)).count() == 0
    alone = rows.filter("y = 'a'")
    assert {(r.pred, r.confidence) for r in M.predict(M.fit_classifier(alone, "y", M.random_forest(3, 2)), alone).collect()} == {("a", 1.0)}
    with pytest.raises(ValueError):
        M.fit_classifier(rows.limit(0), "y", M.random_forest(3, 2))


def test_equal_rows_are_drawn_one_by_one(spark):
    rows = M.vectors(spark.range(400).select(F.lit("a").alias("y"), F.array(F.lit(1.0)).alias("x")), ["x"])
    trees = nodes_of(M.fit_classifier(rows, "y", M.random_forest(6, 2)))
    sizes = [t[0][0] for t in trees.values()]
    assert len(set(sizes)) > 1 and all(320 < s < 480 for s in sizes)


def test_a_deep_forest_takes_no_more_jobs(spark):
    """A level is no job, and there are no groups of nodes that each read all rows."""
    rows, context, jobs = cloud(spark, 400, apart=0.0).localCheckpoint(), spark.sparkContext, []
    for depth in (2, 16):
        context.setJobGroup(f"forest-{depth}", "forest")
        M.fit_classifier(rows, "y", M.random_forest(5, depth))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1]


def test_trees_stay_off_the_driver(spark, monkeypatch):
    sizes = []
    for kind, name in ((RDD, "collect"), (DataFrame, "collect"), (type(spark.range(0)), "collect"), (type(spark.range(0)), "toPandas")):
        def seen(self, plain=getattr(kind, name)):
            out = plain(self)
            sizes.append(len(pickle.dumps(out)))
            return out

        monkeypatch.setattr(kind, name, seen)
    rows = cloud(spark, 900, apart=0.0)
    model = M.fit_classifier(rows, "y", M.random_forest(20, 12))
    report = M.train_and_judge(rows, rows, M.random_forest(20, 12))
    assert report.count() == 1 and sum(sizes) < 20_000
    monkeypatch.undo()
    assert sum(map(len, nodes_of(model).values())) > 3_000


def test_a_forest_is_saved_and_loaded(spark, tmp_path):
    rows = cloud(spark)
    model = M.fit_classifier(rows, "y", M.random_forest(5, 4))
    M.save_model(model, str(tmp_path), "forest", "1", spark, rows=240)
    again = M.load_model(str(tmp_path), "forest", "1")
    assert M.predict(again, rows).select("row_id", "scores.c0", "pred").exceptAll(M.predict(model, rows).select("row_id", "scores.c0", "pred")).count() == 0
    M.save_model(M.fit_classifier(rows, "y", M.random_forest(3, 2)), str(tmp_path), "forest", "1", spark)
    assert M.load_model(str(tmp_path), "forest", "1").trees.select("tree").distinct().count() == 3
