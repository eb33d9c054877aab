"""Model evaluation as aggregations.

Multi-class reports start from the (true, predicted) counts, binary reports from
counts per distinct score or per threshold interval: the row data is aggregated
once and everything after works on tables the size of the report.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions.numbers import safe_ratio
from quietwire.operators.clock import exact_quantiles, prefix_sums, value_bucket, with_scalars

SWEEP = tuple(float(t) for t in np.arange(0.1, 0.95, 0.05))
CONFIDENCE_SWEEP = tuple(float(t) for t in np.arange(0.5, 0.96, 0.05))
ANOMALY_SWEEP = tuple(round(float(t), 2) for t in np.arange(0.2, 0.9, 0.05))
BIN_EDGES = tuple(float(e) for e in np.linspace(0.0, 1.0, 11))
SCORE_RANGES = ((0.0, 0.4, "0.0-0.4"), (0.4, 0.5, "0.4-0.5"), (0.5, 0.6, "0.5-0.6"),
                (0.6, 0.7, "0.6-0.7"), (0.7, 1.0, "0.7-1.0"))
STAT_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def f1_of(precision: Column, recall: Column) -> Column:
    return safe_ratio(precision * recall * 2, precision + recall)


# -- multi-class ------------------------------------------------------------
def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    """Count and share per class, and the ratio of the largest to the smallest."""
    everything = Window.partitionBy(F.lit(0))  # one row per class
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumns({
        "proportion": F.col("n") / F.sum("n").over(everything),
        "imbalance_ratio": F.max("n").over(everything) / F.min("n").over(everything)})


def pair_counts(rows: DataFrame, keys: Sequence[str] = (), true: str = "y", pred: str = "pred") -> DataFrame:
    return rows.groupBy(*keys, F.col(true).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Dense matrix over the union of true and predicted labels."""
    labels = pairs.select(F.explode(F.array("y", "pred")).alias("label")).distinct()
    grid = with_scalars(labels, labels.agg(F.collect_set("label").alias("columns"))).select(
        F.col("label").alias("y"), F.explode("columns").alias("pred"))
    return grid.join(pairs, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest rates of every label that occurs as truth or prediction."""
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    table = (pairs.select(*keys, sides.alias("s")).groupBy(*keys, "s.label")
             .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")]))
    everything = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per class
    table = table.withColumn("total", F.sum("support").over(everything))
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    precision, recall = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    return table.select(*keys, "label", "support", "predicted", "tp", "total",
                        precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"),
                        safe_ratio(fp, F.col("total") - F.col("support")).alias("fpr"),
                        safe_ratio(fn, F.col("support")).alias("fnr"))


def averages(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted means of the per-class table."""
    weight = F.col("support") / F.col("total")
    out = [(F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n")]
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"{m}_macro"), F.sum(F.col(m) * weight).alias(f"{m}_weighted")]
    return classes.groupBy(*keys).agg(*out) if keys else classes.agg(*out)


def missed_by_class(pairs: DataFrame, benign: str) -> DataFrame:
    """How many rows of each threat class were called benign."""
    return (pairs.filter(F.col("y") != benign).groupBy("y")
            .agg(F.sum("n").alias("total_samples"),
                 F.sum(F.when(F.col("pred") == benign, F.col("n")).otherwise(0)).alias("false_negatives"))
            .withColumn("miss_rate", safe_ratio(F.col("false_negatives"), F.col("total_samples"))))


def missed_samples(rows: DataFrame, benign: str, per_label: int = 10) -> DataFrame:
    """The first ``per_label`` misses of every class; the cut is made before the shuffle."""
    missed = rows.filter((F.col("y") != benign) & (F.col("pred") == benign))
    place = Window.partitionBy("y").orderBy("row_id")
    return missed.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_label)


def false_alarm_classes(pairs: DataFrame, benign: str) -> DataFrame:
    """What benign rows were called, as a share of all benign rows."""
    everything = Window.partitionBy(F.lit(0))  # one row per predicted class
    return (pairs.filter(F.col("y") == benign).withColumn("share", F.col("n") / F.sum("n").over(everything))
            .filter(F.col("pred") != benign).select("pred", "n", "share"))


def prevalence(rows: DataFrame, benign: str) -> DataFrame:
    """D61."""
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("y") != benign).cast("double")).alias("prevalence"))


def changed_predictions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two predictions of the same rows side by side."""
    return before.join(after.select("row_id", F.col("pred").alias("pred_after"),
                                    F.col("confidence").alias("confidence_after")), "row_id")


def change_summary(both: DataFrame) -> DataFrame:
    """D50."""
    moved = F.abs(F.col("confidence_after") - F.col("confidence"))
    changed = F.count_if(F.col("pred") != F.col("pred_after"))
    return both.agg(F.count("*").alias("n"), changed.alias("changed"),
                    (changed * 100.0 / F.count("*")).alias("changed_pct"),
                    F.avg(moved).alias("mean_change"), F.max(moved).alias("max_change"))


def recall_change(both: DataFrame) -> DataFrame:
    """Recall per class before and after, and the difference."""
    return (both.groupBy("y").agg(
        F.count("*").alias("support"),
        F.avg((F.col("pred") == F.col("y")).cast("double")).alias("recall_before"),
        F.avg((F.col("pred_after") == F.col("y")).cast("double")).alias("recall_after"))
        .withColumn("recall_change", F.col("recall_after") - F.col("recall_before")))


def metric_rows(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A wide report as (keys, metric, value) rows."""
    return wide.unpivot([*keys], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def metric_delta(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C15."""
    joined = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [*keys, "metric"])
    return joined.withColumn("delta", F.col("new") - F.col("old"))


# -- binary scores ------------------------------------------------------------
def threshold_counts(rows: DataFrame, score: str, thresholds: Sequence[float], measures: dict[str, Column],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Sums of ``measures`` over the rows with score >= t, for every threshold t.

    Each row falls into one interval between thresholds; the intervals are
    summed from the top, so rows are read once whatever the number of thresholds.
    """
    ordered = sorted(thresholds)
    step = F.size(F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: t <= F.col(score)))
    counted = rows.groupBy(*keys, step.alias("step")).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    spark = rows.sparkSession
    grid = spark.createDataFrame([(0, None), *[(i + 1, t) for i, t in enumerate(ordered)]], "step int, threshold double")
    if keys:  # few groups: one row per reported group and step
        groups = counted.select(*keys).distinct()
        steps = grid.agg(F.collect_list(F.struct("step", "threshold")).alias("g"))
        grid = with_scalars(groups, steps).select(*keys, F.inline("g"))
    dense = grid.join(counted, [*keys, "step"], "left").fillna(0, list(measures))
    down = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("step").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return dense.select(*keys, "step", "threshold", *[F.sum(n).over(down).alias(n) for n in measures],
                        *[F.sum(n).over(whole).alias(f"{n}_all") for n in measures]).filter("step > 0").drop("step")


def _binary(y: str) -> dict[str, Column]:
    return {"tp": F.col(y).cast("long"), "fp": (F.lit(1) - F.col(y)).cast("long")}


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR and FNR of a table with tp, fp and their totals."""
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp_all"))
    return counts.withColumns({
        "fn": F.col("tp_all") - F.col("tp"), "tn": F.col("fp_all") - F.col("fp"),
        "precision": precision, "recall": recall, "f1": f1_of(precision, recall),
        "fpr": safe_ratio(F.col("fp"), F.col("fp_all")),
        "fnr": safe_ratio(F.col("tp_all") - F.col("tp"), F.col("tp_all"))}).drop("tp_all", "fp_all")


def threshold_report(rows: DataFrame, thresholds: Sequence[float], y: str = "y", score: str = "score",
                     keys: Sequence[str] = ()) -> DataFrame:
    """D29, D33."""
    return rates(threshold_counts(rows, score, thresholds, _binary(y), keys))


def best_threshold(sweep: DataFrame, objective: str = "f1") -> DataFrame:
    """The first threshold with the largest objective."""
    return sweep.agg(F.max_by("threshold", F.struct(F.col(objective), -F.col("threshold"))).alias("threshold"),
                     F.max(objective).alias("objective"))


def score_curve(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives at every distinct score, best first."""
    counted = rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((F.lit(1) - F.col(y)).cast("long")).alias("neg"))
    placed = counted.withColumn("bucket", -value_bucket(F.col("score")))
    return prefix_sums(placed, "bucket", [F.col("score").desc()],
                       {"tp": F.col("pos"), "fp": F.col("neg")}, keys).drop("bucket")


def curve_areas(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, trapezoid PR-AUC, average precision.

    Each curve point knows its own step (pos, neg), so the previous point needs
    no ordering: the areas are plain sums.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide((tp - pos).cast("double"), (tp - pos + fp - neg).cast("double")), F.lit(1.0))
    P, N = F.sum("pos"), F.sum("neg")
    out = [
        safe_ratio(F.sum(neg * (tp - pos / 2)), P * N).alias("roc_auc"),
        safe_ratio(F.sum(pos * (precision + before) / 2), P).alias("pr_auc"),
        safe_ratio(F.sum(pos * precision), P).alias("average_precision"),
        P.alias("positives"), N.alias("negatives")]
    return curve.groupBy(*keys).agg(*out) if keys else curve.agg(*out)


def operating_points(rows: DataFrame, targets: Sequence[float], default: float = 0.5) -> DataFrame:
    """Threshold, recall and false-positive rate at the default threshold, at the best f1 of the sweep, and nearest to target rates."""
    sweep = threshold_report(rows, SWEEP)
    best = with_scalars(sweep, best_threshold(sweep).select(F.col("threshold").alias("_best"))).filter(F.col("threshold") == F.col("_best"))
    pick = lambda frame, name: frame.select(F.lit(name).alias("point"), "threshold", "recall", "fpr")
    nearest = recall_at_fpr(score_curve(rows), targets)
    near = nearest.select(F.concat(F.lit("fpr "), F.col("target_fpr").cast("string")).alias("point"), "threshold", "recall", F.col("actual_fpr").alias("fpr"))
    return pick(threshold_report(rows, [default]), "default").unionByName(pick(best, "best f1")).unionByName(near)


def recall_at_fpr(curve: DataFrame, targets: Sequence[float]) -> DataFrame:
    """The curve point whose false-positive rate is closest to each target.

    The curve starts at (0, 0).  Points that only continue a straight line are not
    corners of the curve and are not considered, as in the usual ROC convention.
    """
    totals = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rated = with_scalars(curve, totals).select(
        safe_ratio(F.col("fp"), F.col("N")).alias("fpr"), safe_ratio(F.col("tp"), F.col("P")).alias("recall"), "score")
    frames = []
    for target in targets:
        gap = F.abs(F.col("fpr") - F.lit(target))
        best = F.min_by(F.struct("fpr", "recall", "score"), F.struct(gap, -F.col("score")))
        frames.append(rated.agg(best.alias("b")).select(
            F.lit(target).alias("target_fpr"), F.col("b.fpr").alias("actual_fpr"), F.col("b.recall").alias("recall"),
            F.col("b.score").alias("threshold")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sampled_curve(curve: DataFrame, points: int = 200) -> DataFrame:
    """At most ``points`` evenly spaced points of the curve, ends included."""
    numbered = prefix_sums(curve.withColumn("bucket", -value_bucket(F.col("score"))), "bucket",
                           [F.col("score").desc()], {"place": F.lit(1).cast("long")}).drop("bucket")
    totals = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count("*").alias("size"))
    rows = with_scalars(numbered, totals)
    last = F.lit(points - 1)
    # point i of the sample is curve row floor(i * (size-1) / (points-1))
    i = F.ceil((F.col("place") - 1) * last / F.greatest(F.col("size") - 1, F.lit(1)))
    chosen = (F.col("size") <= points) | (
        (i < points) & (F.floor(i * (F.col("size") - 1) / last) == F.col("place") - 1))
    return rows.filter(chosen).select(safe_ratio(F.col("fp"), F.col("N")).alias("fpr"),
                                      safe_ratio(F.col("tp"), F.col("P")).alias("tpr"), "score")


def score_statistics(rows: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Moments, extremes and exact quantiles per group."""
    moments = rows.groupBy(*keys).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"))
    return moments.join(exact_quantiles(rows, keys, score, STAT_QUANTILES), list(keys))


def novelty_ranking(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Distance of the group medians and how well the score ranks attacks first."""
    medians = exact_quantiles(rows, [y], score, {"median": 0.5})
    sides = medians.agg(F.max(F.when(F.col(y) == 0, F.col("median"))).alias("benign_median"),
                        F.max(F.when(F.col(y) == 1, F.col("median"))).alias("attack_median"))
    return with_scalars(curve_areas(score_curve(rows, y, score)), sides).withColumn(
        "median_separation", F.col("attack_median") - F.col("benign_median"))


def upper_quantile(rows: DataFrame, score: str, q: float) -> DataFrame:
    """The smallest observed value at or above the quantile position."""
    counted = rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    cum = prefix_sums(counted.withColumn("bucket", value_bucket(F.col("score"))), "bucket", ["score"],
                      {"upto": F.col("n")})
    total = counted.agg(F.sum("n").alias("total"))
    rank = F.ceil(F.lit(q) * (F.col("total") - 1)) + 1
    return with_scalars(cum, total).filter(F.col("upto") >= rank).agg(F.min("score").alias("threshold"))


def brier(rows: DataFrame, y: str = "y", score: str = "score") -> Column:
    """D41."""
    return F.avg(F.pow(F.col(score) - F.col(y), 2))


def reliability(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Ten bins, the last one closed, empty bins reported as zeros."""
    n = len(BIN_EDGES) - 1
    inner = F.array(*[F.lit(e) for e in BIN_EDGES[1:-1]])
    number = F.size(F.filter(inner, lambda e: e <= F.col(score)))
    counted = (rows.filter(F.col(score).between(0.0, 1.0)).groupBy(number.alias("bin"))
               .agg(F.count("*").alias("count"), F.avg(F.col(y).cast("double")).alias("observed_frequency"),
                    F.avg(score).alias("predicted_mean")))
    bins = rows.sparkSession.createDataFrame(
        [(i, (BIN_EDGES[i] + BIN_EDGES[i + 1]) / 2) for i in range(n)], "bin int, bin_center double")
    return bins.join(counted, "bin", "left").fillna(0, ["count"]).fillna(
        0.0, ["observed_frequency", "predicted_mean"])


def calibration_error(diagram: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    gap = F.abs(F.col("observed_frequency") - F.col("predicted_mean"))
    return diagram.agg(safe_ratio(F.sum(F.col("count") * gap), F.sum("count")).alias("ece"),
                       F.sum("count").alias("n"))


def calibration_gate(rows: DataFrame, model: str) -> DataFrame:
    """Calibration of each model; anomaly scores are no probabilities and get none."""
    applicable = F.col(model) != "isolation_forest"
    value = F.when(applicable, F.pow(F.col("score") - F.col("y"), 2))
    return rows.groupBy(model).agg(F.count("*").alias("n"), F.avg(value).alias("brier"),
                                   F.first(applicable).alias("applicable"))


def false_positives_by(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    """False alarms among benign rows per scenario."""
    fp = F.count_if((F.col("y") == 0) & (F.col("score") >= threshold))
    benign = F.count_if(F.col("y") == 0)
    return rows.groupBy(group).agg(fp.alias("false_positives"), benign.alias("total_benign")).withColumn(
        "fp_rate", F.col("false_positives") / F.greatest(F.col("total_benign"), F.lit(1)))


def false_positive_ranges(rows: DataFrame, threshold: float) -> DataFrame:
    """False alarms per half-open score range; a score of 1.0 is in none."""
    label = None
    for low, high, name in SCORE_RANGES:
        test = (F.col("score") >= low) & (F.col("score") < high)
        label = F.when(test, name) if label is None else label.when(test, name)
    counted = (rows.filter((F.col("y") == 0) & (F.col("score") >= threshold))
               .groupBy(label.alias("score_range")).agg(F.count("*").alias("n")))
    names = rows.sparkSession.createDataFrame([(r[2],) for r in SCORE_RANGES], "score_range string")
    return names.join(counted, "score_range", "left").select(
        "score_range", F.coalesce("n", F.lit(0)).alias("false_positives"))


# -- fusion of a classifier and an anomaly score --------------------------------
def fusion_thresholds(rows: DataFrame, benign: str = "benign") -> DataFrame:
    """One row with tau_known, tau_anomaly and tau_benign, learned on ``rows``.

    Columns: y_true, pred, confidence, score.
    """
    alarms = rows.filter(F.col("pred") != benign)
    correct = ((F.col("y_true") != benign) & (F.col("pred") == F.col("y_true"))).cast("long")
    known = threshold_counts(alarms, "confidence", CONFIDENCE_SWEEP, {"right": correct, "above": F.lit(1).cast("long")})
    f1 = f1_of(safe_ratio(F.col("right"), F.col("above")), safe_ratio(F.col("above"), F.col("above_all")))
    known = known.withColumn("f1", f1).agg(
        F.max("above_all").alias("alarms"),
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("t"), F.max("f1").alias("top"))
    tau_known = F.when(F.col("alarms") > 0, F.when(F.col("top") > 0, F.col("t")).otherwise(0.5)).otherwise(0.8)
    attacks = rows.withColumn("y", (F.col("y_true") != benign).cast("int"))
    sweep = threshold_report(attacks, ANOMALY_SWEEP).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("t"), F.max("f1").alias("top"))
    tau_anomaly = F.when(F.col("top") > 0, F.col("t")).otherwise(0.5)
    low = exact_quantiles(rows.filter(F.col("y_true") == benign), [], "score", {"q": 0.25})
    low = low.agg(F.coalesce(F.max("q"), F.lit(0.3)).alias("tau_benign"))
    out = known.select(tau_known.alias("tau_known"))
    return with_scalars(with_scalars(out, sweep.select(tau_anomaly.alias("tau_anomaly"))), low)


def fusion_category(rows: DataFrame, thresholds: DataFrame, benign: str = "benign") -> DataFrame:
    """D35."""
    r = with_scalars(rows, thresholds)
    category = (F.when((F.col("pred") != benign) & (F.col("confidence") >= F.col("tau_known")), "KNOWN_ATTACK")
                 .when(F.col("score") >= F.col("tau_anomaly"), "NOVEL_ANOMALY")
                 .when((F.col("pred") == benign) & (F.col("score") < F.col("tau_benign")), "BENIGN")
                 .otherwise("UNCERTAIN"))
    return r.withColumn("category", category)


def fusion_report(rows: DataFrame, known: Sequence[str], benign: str = "benign") -> DataFrame:
    """Outcome counters and the binary rates of the fused decision."""
    quiet, c = F.col("y_true") == benign, F.col("category")
    found = c.isin("KNOWN_ATTACK", "NOVEL_ANOMALY")
    out = rows.agg(
        F.count_if((c == "KNOWN_ATTACK") & ~quiet & F.col("y_true").isin(*known)).alias("tp_known_attack"),
        F.count_if((c == "NOVEL_ANOMALY") & ~quiet).alias("tp_novel_anomaly"),
        F.count_if((c == "BENIGN") & quiet).alias("tn_benign"),
        F.count_if((c == "KNOWN_ATTACK") & quiet).alias("fp_known"),
        F.count_if((c == "NOVEL_ANOMALY") & quiet).alias("fp_novel"),
        F.count_if((c == "BENIGN") & ~quiet).alias("fn_missed_as_benign"),
        F.count_if(c == "UNCERTAIN").alias("n_uncertain"), F.count("*").alias("n_total"),
        F.count_if(found & ~quiet).alias("hit"), F.count_if(found).alias("found"), F.count_if(~quiet).alias("attacks"))
    precision, recall = safe_ratio(F.col("hit"), F.col("found")), safe_ratio(F.col("hit"), F.col("attacks"))
    return out.withColumns({"binary_precision": precision, "binary_recall": recall,
                            "binary_f1": f1_of(precision, recall)}).drop("hit", "found", "attacks")


def spread_of(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and range of fold or seed results."""
    out = [F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
           F.min(value).alias("min"), F.max(value).alias("max")]
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def side_by_side(rows: DataFrame, key: str, kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """One row per key with the value of each kind."""
    return rows.groupBy(key).pivot(kind, list(kinds)).agg(F.first(value))


FAILURES = S.FAILURE_CODES
