"""Boosting against its stored node table walked in SQL, a plain loop, and odd rows."""

import pickle

import duckdb
import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from quietwire.operators import boosting as G
from quietwire.operators import models as M

WALK = """
with recursive entries as (select row_id, unnest(x) as v, unnest(range(len(x))) as f from rows),
walk as (select r.row_id, n.round, n.class, n.node from rows r, nodes n where n.node = 0
 union all
 select w.row_id, w.round, w.class, case when e.v >= n.threshold then n."right" else n."left" end from walk w
  join nodes n on n.round = w.round and n.class = w.class and n.node = w.node and n.feature is not null join entries e on e.row_id = w.row_id and e.f = n.feature),
sums as (select w.row_id, w.class, sum(n.value) as margin from walk w join nodes n on n.round = w.round and n.class = w.class and n.node = w.node
 where n.feature is null group by all)
select row_id, arg_max(class, (margin, -ascii(substr(class, 2)))) as pred from sums group by row_id"""


def cloud(spark, n=240, parts=5):
    rng = np.random.default_rng(8)
    rows = [(i, f"c{i % 3}", [float(v) for v in rng.normal(1.2 * (i % 3), 1, 6)]) for i in range(n)]
    return M.vectors(spark.createDataFrame(rows, "row_id long, y string, x array<double>").repartition(parts), ["x"])


def test_predictions_equal_a_walk_of_the_stored_nodes(spark):
    rows = cloud(spark)
    model = M.fit_classifier(rows, "y", M.boosted(12, 4))
    got = {r.row_id: r for r in M.predict(model, rows).collect()}
    con = duckdb.connect()
    con.register("rows", rows.select("row_id", "x").toPandas())
    con.register("nodes", model.node_table(spark).toPandas())
    walked = dict(con.execute(WALK).fetchall())
    assert walked == {i: r.pred for i, r in got.items()}
    assert sum(r.pred == r.y for r in got.values()) > 200
    assert all(abs(sum(r.scores.values()) - 1) < 1e-9 and r.confidence == max(r.scores.values()) for r in got.values())


def test_fit_does_not_depend_on_partitions_or_refreshes(spark, monkeypatch):
    def margins(parts, refresh):
        monkeypatch.setattr(G, "REFRESH", refresh)
        model = G.fit_boosted(cloud(spark, parts=parts), "y", G.Boosting(5, 3))
        return {r.row_id: r.m for r in cloud(spark).select("row_id", model.margins(F.col("x")).alias("m")).collect()}

    one, other = margins(1, 10), margins(7, 2)
    assert all(np.allclose(one[i], other[i]) for i in one)


def test_first_round_against_a_plain_search(spark):
    rows = cloud(spark)
    model = G.fit_boosted(rows, "y", G.Boosting(1, 1))
    data = rows.select("x", "y").collect()
    x, y = np.array([r.x for r in data]), np.array([r.y for r in data])
    for c, name in enumerate(model.classes):
        g, h = 1 / 3 - (y == name), np.full(len(y), 2 / 9)
        gain = lambda f, cut: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, f] < cut, x[:, f] >= cut))
        best = max(gain(f, cut) for f, cuts in enumerate(model.cuts) for cut in cuts if min(h[x[:, f] < cut].sum(), h[x[:, f] >= cut].sum()) >= 1)
        tree = model.rounds[0]
        f = tree.feature[c, 0]
        cut = model.cuts[f][tree.cut[c, 0]]
        assert gain(f, cut) == pytest.approx(best)
        left = x[:, f] < cut
        assert tree.value[c, 1] == pytest.approx(-0.1 * g[left].sum() / (h[left].sum() + 1))


def test_missing_values_one_class_and_no_rows(spark):
    rows = M.vectors(spark.createDataFrame([(i, "a" if i % 2 else "b", [float("nan") if i % 3 == 0 else float(i), float(i % 2)]) for i in range(60)],
                                           "row_id long, y string, x array<double>"), ["x"])
    out = M.predict(M.fit_classifier(rows, "y", M.boosted(8, 2)), rows)
    assert out.filter("y = pred").count() == 60
    alone = rows.filter("y = 'a'")
    assert {(r.pred, r.confidence) for r in M.predict(M.fit_classifier(alone, "y", M.boosted(3, 2)), alone).collect()} == {("a", 1.0)}
    nulls = rows.withColumn("y", F.lit(None).cast("string"))
    assert {r.pred for r in M.predict(M.fit_classifier(nulls, "y", M.boosted(3, 2)), rows).collect()} == {None}


def test_histograms_stay_off_the_driver(spark, monkeypatch):
    sizes, plain = [], RDD.collect

    def collect(self):
        out = plain(self)
        sizes.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(RDD, "collect", collect)
    model = G.fit_boosted(cloud(spark), "y", G.Boosting(4, 3))
    assert sum(int((t.feature >= 0).sum()) for t in model.rounds) > 12 and len(sizes) >= 4
    assert max(sizes) < 3 * 4 * 100  # classes, nodes of the last level, bytes of a split; the sums take 9 kB for a node
