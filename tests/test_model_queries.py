"""The registered comparison, run on a sample folder at its full settings, and the defaults of the survey."""

import numpy as np
import pandas as pd
import pytest

from quietwire.operators.boosting import Boosting
from quietwire.operators.clock import exact_quantiles
from quietwire.plans import catalogue

Q = catalogue.model_queries


def test_defaults_of_the_survey():
    forest = Q.M.random_forest()
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 16) and Q.M.boosted() == Boosting(100, 6, 0.1)


def test_comparison_runs_at_full_settings(spark, tmp_path):
    rng = np.random.default_rng(4)
    label = np.arange(120) % 3
    x = rng.standard_normal((120, 64)) * 0.3
    x[np.arange(120), label] += 2.0
    pd.DataFrame({"vec_id": np.arange(120), "embedding": list(x.astype(np.float32)), "label": label.astype(np.int32)}).to_parquet(tmp_path / "embeddings.parquet")
    got = {r.model: r for r in Q.model_comparison(spark, str(tmp_path)).collect()}
    assert set(got) == {"logistic", "forest", "boosted"} and min(r.accuracy for r in got.values()) > 0.9


class _Seen(Exception):
    pass


def test_fits_read_stored_scaled_flows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    n = 300
    pd.DataFrame({"event_id": np.arange(n), "ts": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 900, unit="s")).astype("datetime64[us]"),
                  "user_id": rng.integers(0, 60, n), "event_type": rng.choice(["view", "click", "signup", "purchase", "error"], n),
                  "value": rng.random(n).round(2) * 100, "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)]}).to_parquet(tmp_path / "events.parquet")
    plans = []

    def fit(rows, label, estimator):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        raise _Seen

    monkeypatch.setattr(Q.M, "fit_classifier", fit)
    for query in (Q.perturbed_detections, Q.flow_detections):
        with pytest.raises(_Seen):
            query(spark, str(tmp_path))
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("Aggregate", "Join"))
    rows = Q.B.stored_features(spark, str(tmp_path))
    want = Q.D.standardise(rows, Q.D.scaling_statistics(rows)).select("flow_id", "label", *Q.S.LINEAR_FEATURES)
    got = {r.flow_id: r for r in Q._scaled(spark, str(tmp_path)).collect()}
    assert len(got) == rows.count() > 10
    for r in want.collect():
        assert r.label == got[r.flow_id].label and np.allclose(r[2:], got[r.flow_id][2:])


def test_quantiles_of_few_keys_leave_the_rows_in_place(spark):
    rows = spark.range(500).selectExpr("concat('f', id % 3) as feature", "cast((id * 37) % 101 as double) as value")
    few = exact_quantiles(rows, ["feature"], "value", {"median": 0.5}, few_keys=True)
    assert sorted(few.collect()) == sorted(exact_quantiles(rows, ["feature"], "value", {"median": 0.5}).collect())
    assert "rightHint=(strategy=broadcast)" in Q.D.medians(rows.selectExpr("value as a", "value + 1 as b"), ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
