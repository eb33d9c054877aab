import numpy as np
from pyspark.sql import functions as F

from quietwire.operators import detect as D
from quietwire.operators import models as M


def cloud(spark, n=300):
    rng = np.random.default_rng(6)
    rows = [(i, f"c{i % 3}", [float(v) for v in rng.normal(3 * (i % 3), 1, 4)]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y string, x array<double>")


def test_outliers_score_higher(spark):
    rows = cloud(spark).filter("y = 'c0'")
    forest = M.fit_isolation_forest(rows, ["x"], "row_id", trees=20, sample=64)
    assert forest.select("tree").distinct().count() == 20
    far = spark.createDataFrame([(1, [30.0, -30.0, 30.0, -30.0]), (2, [0.0, 0.0, 0.0, 0.0])], "row_id long, x array<double>")
    got = {r.row_id: r.score for r in M.anomaly_scores(far, forest, ["x"]).collect()}
    assert got[1] > 0.6 > got[2] > 0.3


def test_average_path():
    assert M.average_path(1) == 0 and M.average_path(2) == 1 and abs(float(M.average_path(256)) - 10.24) < 0.02


def test_classifier_round_trip(spark, tmp_path):
    rows = M.vectors(cloud(spark), ["x"])
    model = M.fit_classifier(rows, "y", M.logistic(max_iter=50))
    out = M.predict(model, rows)
    assert out.filter("y = pred").count() > 280
    first = out.first()
    assert abs(sum(first.scores.values()) - 1) < 1e-9 and first.confidence == max(first.scores.values())
    M.save_model(model, str(tmp_path), "lr", "1", spark, rows=300)
    again = M.predict(M.load_model(str(tmp_path), "lr", "1"), rows)
    assert again.select("row_id", "pred").exceptAll(out.select("row_id", "pred")).count() == 0
    assert [(r.name, r.version) for r in M.list_models(spark, str(tmp_path)).collect()] == [("lr", "1")]
    parts = M.linear_contributions(model, rows, list("abcd"), ["row_id"])
    assert parts.count() == 1200


def test_boosted_scores_sum_to_one(spark):
    rows = M.vectors(cloud(spark, 120), ["x"])
    out = M.predict(M.fit_classifier(rows, "y", M.boosted(2, 2)), rows)
    assert all(abs(sum(r.scores.values()) - 1) < 1e-9 for r in out.collect())


def test_noise_is_repeatable_and_keeps_missing(spark):
    columns = ", ".join(f"{c} double" for c in D.IAT_FEATURES + D.SIZE_FEATURES)
    n = len(D.IAT_FEATURES + D.SIZE_FEATURES)
    rows = spark.createDataFrame([("a", *[1.0] * n), ("b", None, *[0.0] * (n - 1))], "flow_id string, " + columns)
    one, two = (D.size_noise(D.timing_jitter(r, "flow_id"), "flow_id").orderBy("flow_id").collect() for r in (rows, rows.repartition(3)))
    assert one == two and one[1][1] is None
    assert all(r[c] >= 0 for r in one for c in D.SIZE_FEATURES)
    assert D.random_drop(rows, "flow_id", 1.0, columns=D.IAT_FEATURES).filter(F.col(D.IAT_FEATURES[1]) == 0).count() == 2


def test_stability_holds_one_model_at_a_time(spark):
    """Every report is a stored row before the next model is fitted: the result no longer needs any of the models."""
    rows = M.vectors(cloud(spark, 120), ["x"])
    out = M.seed_stability(rows, rows, lambda s: M.random_forest(3, 2, s), (1, 2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "parquet" in plan
    assert out.count() == 1
