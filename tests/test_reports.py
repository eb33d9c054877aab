import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import numbers as N
from quietwire.operators import detect as D
from quietwire.operators import evaluate as A
from quietwire.operators import events as E
from quietwire.operators import features as FE
from quietwire.operators import splits as L
from quietwire.session import cut_lineage


def scores(spark, pairs):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(pairs)], "row_id long, y int, score double")


def test_curve_areas_with_ties(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(rng.random() < 0.4), round(float(rng.random()), 1)) for _ in range(200)]
    got = A.curve_areas(A.score_curve(scores(spark, pairs))).first()
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got.roc_auc == pytest.approx(wins)
    ap, tp, seen = 0.0, 0, 0
    for t in sorted({s for _, s in pairs}, reverse=True):
        at = [y for y, s in pairs if s == t]
        tp, seen = tp + sum(at), seen + len(at)
        ap += sum(at) / len(pos) * tp / seen
    assert got.average_precision == pytest.approx(ap)


def test_threshold_report_equals_counting(spark):
    pairs = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (1, 0.1)]
    got = {round(r.threshold, 2): r for r in A.threshold_report(scores(spark, pairs), [0.5, 0.95, 0.1]).collect()}
    assert (got[0.5].tp, got[0.5].fp, got[0.5].fn, got[0.5].tn) == (2, 1, 1, 1)
    assert (got[0.95].tp, got[0.95].precision, got[0.95].f1) == (0, 0.0, 0.0)
    assert got[0.1].recall == 1.0


def test_first_best_threshold_wins(spark):
    sweep = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "threshold double, f1 double")
    assert tuple(A.best_threshold(sweep).first()) == (0.2, 0.7)


def test_top_score_is_in_the_last_bin_but_in_no_range(spark):
    rows = scores(spark, [(0, 1.0), (0, 0.95), (1, 0.05)])
    bins = {r.bin: r["count"] for r in A.reliability(rows).collect()}
    assert bins[9] == 2 and bins[0] == 1 and bins[5] == 0 and len(bins) == 10
    ranges = {r.score_range: r.false_positives for r in A.false_positive_ranges(rows, 0.5).collect()}
    assert ranges["0.7-1.0"] == 1


def test_per_class_covers_predicted_only_labels(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "y string, pred string")
    got = {r.label: r for r in A.per_class(A.pair_counts(rows)).collect()}
    assert (got["z"].support, got["z"].precision, got["z"].recall, got["z"].fnr) == (0, 0.0, 0.0, 0.0)
    assert got["a"].fnr == 0.5 and got["z"].fpr == pytest.approx(1 / 3)
    assert A.averages(A.per_class(A.pair_counts(rows))).first().recall_macro == pytest.approx(0.5)


def test_upper_quantile_and_statistics(spark):
    values = [0.1, 0.2, 0.3, 0.4, 0.5]
    rows = scores(spark, [(0, v) for v in values])
    assert A.upper_quantile(rows, "score", 0.9).first()[0] == np.quantile(values, 0.9, method="higher")
    s = A.score_statistics(rows, ["y"]).first()
    assert (s.median, s.p90) == (pytest.approx(0.3), pytest.approx(np.percentile(values, 90)))


def test_fusion_defaults_without_alarms(spark):
    rows = spark.createDataFrame([("benign", "benign", 0.9, 0.2), ("ddos", "benign", 0.9, 0.6)], "y_true string, pred string, confidence double, score double")
    t = A.fusion_thresholds(rows).first()
    assert (t.tau_known, t.tau_benign) == (0.8, pytest.approx(0.2))


def test_ratios_and_numbers(spark):
    rows = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = rows.select(N.safe_ratio(F.col("a"), F.col("b")), N.guarded_ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 3.0), (1.5, 1.5)]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,), (1.0,)], "x double")
    assert [r[0] for r in odd.select(N.missing_if_not_finite(F.col("x"))).collect()] == [None, None, None, 1.0]
    cuts = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.3,), (0.29,)], "x double")
    assert [r[0] for r in cuts.select(N.severity(F.col("x"))).collect()] == ["critical", "high", "medium", "low", "info"]


def test_imputation_and_scaling(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, None), (9.0, 5.0, None)], "a double, b double, c double")
    stats = D.scaling_statistics(rows, ["a", "b", "c"])
    full = np.array([1.0, 2.0, 2.0, 9.0])
    got = {r.feature: r for r in stats.collect()}
    assert got["a"].median == 2.0 and got["a"].mean == pytest.approx(full.mean()) and got["a"].std == pytest.approx(full.std())
    assert got["b"].std == 1.0 and "c" not in got
    z = [r.a for r in D.standardise(rows, stats, ["a", "b"]).collect()]
    assert z == pytest.approx(list((full - full.mean()) / full.std()))


def test_failure_codes(spark):
    base = {f: 1.0 for f in S.FEATURES} | {"total_packets": 10.0}
    silent = base | {f: 0.0 for f in D.REVERSE_FEATURES}
    stats = spark.createDataFrame([(f, 1.0, 1.0) for f in S.FEATURES], "feature string, mean double, std double")
    rows = [("benign", "ddos", 0.95, base), ("ddos", "benign", 0.55, silent | {"total_packets": 2.0}), ("other", "benign", 0.1, base | {"duration_sec": 9.0})]
    frame = spark.createDataFrame([(lab, p, s, *[f[n] for n in S.FEATURES]) for lab, p, s, f in rows],
                                  "label string, pred string, anomaly_score double, " + ", ".join(f"{n} double" for n in S.FEATURES))
    frame = frame.withColumn("total_packets", F.when(F.col("total_packets") == 10.0, 3.0).otherwise(F.col("total_packets")))
    share = spark.createDataFrame([("benign", 0.9), ("ddos", 0.06), ("other", 0.04)], "label string, share double")
    got = {r.label: list(r.codes) for r in D.failure_codes(frame, stats, share).collect()}
    assert got == {"benign": ["F1"], "ddos": ["F3", "F2", "F9"], "other": ["F6", "F7", "F8"]}


def test_neighbourhoods_equal_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(f"e{i:03d}", float(rng.integers(0, 2000)), f"f{min(int(rng.integers(6)), 2)}") for i in range(150)]
    frame = spark.createDataFrame(rows, "event_id string, timestamp double, flow_id string")
    got = {}
    for r in E.neighbourhoods(frame, 300.0, 5).orderBy("anchor_id", "place").collect():
        got.setdefault(r.anchor_id, []).append((r.other_id, r.truncated))
    for eid, ts, flow in rows:
        near = sorted((t, e) for e, t, f in rows if f == flow and abs(t - ts) <= 300 and e != eid)
        expected = [eid, *[e for _, e in near]]
        assert [o for o, _ in got[eid]] == expected[:5]
        assert all(t is (len(expected) > 5) for _, t in got[eid])


def test_splits(spark):
    rows = spark.createDataFrame([(i, f"s{i % 10}", float(i % 7)) for i in range(100)], "row_id long, scenario string, ts double")
    parts = {r.scenario: r.split for r in L.scenario_split(rows).collect()}
    assert sorted(parts.values()).count("train") == 7 and "test" in parts.values()
    split = L.temporal_split(rows, "ts", "row_id", 2.0).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 70, "validation": 15, "test": 15}
    assert L.uniform_sample(rows, "row_id", 13).count() == 13
    assert L.stratified_sample(rows, "scenario", "row_id", 3).count() == 30


def test_feature_record_check(spark):
    names = list(S.FEATURES)
    good = (names, [1.0] * 52, {n: 1.0 for n in names})
    bad = (names, [2.0] + [1.0] * 51, {n: 1.0 for n in names})
    frame = spark.createDataFrame([good, bad, (names[:-1], [1.0] * 51, {n: 1.0 for n in names})],
                                  "names array<string>, values array<double>, features map<string,double>")
    assert [r[0] for r in frame.select(FE.features_valid()).collect()] == [True, False, False]


def test_merged_evidence(spark):
    item = "struct<place:double,feature_name:string,contribution:double>"
    kind = f"struct<items:array<{item}>,explanation_available:boolean,unavailable_reason:string>"
    rows = [(([(-1.0, "a", 1.0)], True, None), ([(-3.0, "b", 3.0)], True, None)), (([], False, "x"), ([], False, "y"))]
    got = spark.createDataFrame(rows, f"p {kind}, q {kind}").select(D.merged_evidence("p", "q").alias("m")).collect()
    assert [i.feature_name for i in got[0].m["items"]] == ["b", "a"] and got[0].m.explanation_available
    assert (got[1].m.explanation_available, got[1].m.unavailable_reason) == (False, "x; y")


def test_joins_of_stored_tables_do_not_pass_through_the_driver(spark):
    """A stored table is packed, so its files look small enough to broadcast at any size."""
    stored = cut_lineage(spark.range(1000).withColumn("v", F.col("id") % 7))
    plan = stored.join(stored.groupBy("id").agg(F.max("v").alias("top")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    small = stored.join(F.broadcast(spark.range(7).withColumnRenamed("id", "v")), "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small
