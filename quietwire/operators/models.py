"""Models: isolation forest, linear, forest and boosted classifiers, and the experiments around them
(A15, K6-K12, K14-K17, K19, K21, K28, K29)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwire.operators import evaluate as A
from quietwire.operators.boosting import BoostedModel, Boosting, fit_boosted
from quietwire.operators.forest import Forest, ForestModel, fit_forest
from quietwire.operators.splits import uniform_sample
from quietwire.session import cut_lineage

FOREST = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("path", T.DoubleType()), T.StructField("sample", T.IntegerType())])


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` points (Liu et al. 2008)."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


# -- isolation forest ------------------------------------------------------------
def draw(seed: int, tree: int, node: int, turn: int) -> float:
    """A number from 0 up to 1 that belongs to a node: the same wherever and whenever the tree is grown."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{turn}".encode()).hexdigest()[:8], 16) / 2.0 ** 32


def _grow(points: np.ndarray, seed: int, tree: int, limit: int) -> list[list]:
    """Node rows of one tree (children of i: 2i+1, 2i+2); leaves carry depth plus the expected rest of the path."""
    nodes: list[list] = []
    todo = [(np.arange(len(points)), 0, 0)]
    while todo:
        rows, depth, number = todo.pop()
        x = points[rows]
        low, high = (x.min(axis=0), x.max(axis=0)) if len(rows) else (None, None)
        usable = np.flatnonzero(high > low) if len(rows) > 1 else np.array([], dtype=int)
        if depth >= limit or len(usable) == 0:
            nodes.append([number, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        f = int(usable[int(draw(seed, tree, number, 0) * len(usable))])
        cut = float(low[f] + draw(seed, tree, number, 1) * (high[f] - low[f]))
        nodes.append([number, f, cut, 2 * number + 1, 2 * number + 2, 0.0])
        below = x[:, f] < cut
        todo += [(rows[~below], depth + 1, 2 * number + 2), (rows[below], depth + 1, 2 * number + 1)]
    return nodes


def fit_isolation_forest(rows: DataFrame, columns: Sequence[str], identity: str, trees: int = 100,
                         sample: int = 256, seed: int = 42) -> DataFrame:
    """K6: the node table of an isolation forest.

    A pool of at most trees*sample rows is drawn first; every tree takes its own
    ``sample`` of the pool.  Trees are grown in parallel, one small group each.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns]) if len(columns) > 1 else F.col(columns[0]).cast("array<double>")
    pool = uniform_sample(rows.select(F.col(identity).cast("string").alias("_id"), values.alias("_x")), "_id", trees * sample, seed)
    offered = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = F.md5(F.concat(F.col("tree").cast("string"), F.lit(":"), "_id", F.lit(f"#{seed}")))
    place = Window.partitionBy("tree").orderBy(order, "_id")
    taken = offered.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= sample).select("tree", "_id", "_x")

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(group.sort_values("_id")["_x"].to_numpy())
        n = len(points)
        limit = int(np.ceil(np.log2(max(n, 2))))
        rows_ = _grow(points, seed, int(key[0]), limit)
        return pd.DataFrame([[int(key[0]), *r, n] for r in rows_], columns=FOREST.names)

    return taken.groupBy("tree").applyInPandas(grow, FOREST)


def forest_scorer(forest: DataFrame) -> Callable:
    """K7: an array<double> -> score function: 2 ** (-mean path / expected path).

    The node table has at most trees * 2 * sample rows, whatever it was trained on.
    """
    nodes = forest.toPandas()
    psi = float(nodes["sample"].max())
    trees = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    packed = []
    for g in trees:  # children by their place in the table
        feature, split, path = (g[c].to_numpy() for c in ("feature", "split", "path"))
        left, right = (np.searchsorted(g["node"].to_numpy(), g[c].to_numpy()) for c in ("left", "right"))
        packed.append((feature, split, left, right, path))
    scale = max(float(average_path(psi)), 1e-12)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            depth = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, split, left, right, path in packed:
                at = np.zeros(len(x), dtype=int)
                inner = feature[at] >= 0
                while inner.any():
                    here, f = every[inner], feature[at[inner]]
                    go_left = x[here, f] < split[at[inner]]
                    at[inner] = np.where(go_left, left[at[inner]], right[at[inner]])
                    inner = feature[at] >= 0
                depth += path[at]
            yield pd.Series(np.clip(2.0 ** (-depth / len(packed) / scale), 0.0, 1.0))

    return score


def anomaly_scores(rows: DataFrame, forest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K7: adds ``score``."""
    values = F.array(*[F.col(c).cast("double") for c in columns]) if len(columns) > 1 else F.col(columns[0]).cast("array<double>")
    return rows.withColumn("score", forest_scorer(forest)(values))


# -- classifiers -------------------------------------------------------------------
def vectors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The feature vector; one array column or several numeric ones."""
    if len(columns) == 1:
        return rows.withColumn("features", array_to_vector(F.col(columns[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(rows)


def logistic(penalty: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """K8: multinomial regression; the penalty weight is per training set, so ``fit_classifier`` divides it by the number of rows."""
    return LogisticRegression(family="multinomial", regParam=1.0 / penalty, elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter, labelCol="label_index")


def random_forest(trees: int = 100, depth: int = 16, seed: int = 42) -> Forest:
    """K9: trees that are grown, kept and asked in tasks."""
    return Forest(trees, depth, seed)


def boosted(rounds: int = 100, depth: int = 6, rate: float = 0.1) -> Boosting:
    """Multiclass boosting over histograms."""
    return Boosting(rounds, depth, rate)


def fit_classifier(rows: DataFrame, label: str, estimator) -> PipelineModel | BoostedModel | ForestModel:
    """``rows`` carries ``features``; class names travel with the model."""
    if isinstance(estimator, Boosting):
        return fit_boosted(rows, label, estimator)
    if isinstance(estimator, Forest):
        return fit_forest(rows, label, estimator)
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    fitted = index.fit(rows)
    if isinstance(estimator, LogisticRegression):
        estimator = estimator.copy({estimator.regParam: estimator.getRegParam() / max(rows.count(), 1)})
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=fitted.labels)
    return PipelineModel(stages=[fitted, Pipeline(stages=[estimator, names]).fit(fitted.transform(rows))])


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel | BoostedModel | ForestModel, rows: DataFrame) -> DataFrame:
    """Adds ``pred``, ``scores`` (class -> score) and ``confidence`` of the chosen class."""
    if isinstance(model, BoostedModel | ForestModel):
        return model.predict(rows)
    names = class_names(model)
    out = model.transform(rows)
    values = F.slice(vector_to_array(F.col("probability")), 1, len(names))
    scores = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values)
    return out.withColumn("scores", scores).withColumn("confidence", F.try_element_at("scores", F.col("pred")))


def linear_contributions(model: PipelineModel, rows: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Signed contribution of every feature to the predicted class, in long form."""
    fitted = model.stages[1].stages[0]
    weights = fitted.coefficientMatrix.toArray().tolist()
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    chosen = F.get(table, F.col("prediction").cast("int"))
    parts = F.zip_with(vector_to_array("features"), chosen, lambda x, w: x * w)
    labelled = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature_name"), parts.alias("contribution"))
    out = predict(model, rows).withColumn("prediction", F.col("prediction"))
    return out.select(*keep, "pred", F.inline(labelled)).withColumn(
        "direction", F.when(F.col("contribution") > 0, "increase").otherwise("decrease"))


# -- stored models -----------------------------------------------------------------
def save_model(model: PipelineModel | ForestModel, root: str, name: str, version: str, spark, **facts) -> None:
    """The model and a one-row manifest under ``root/name/version``."""
    path = f"{root}/{name}/{version}/model"
    model.save(path) if isinstance(model, ForestModel) else model.write().overwrite().save(path)
    row = [(name, version, json.dumps(facts, sort_keys=True))]
    spark.createDataFrame(row, "name string, version string, facts string").coalesce(1).write.mode("overwrite").json(
        f"{root}/{name}/{version}/manifest")


def load_model(root: str, name: str, version: str) -> PipelineModel | ForestModel:
    path = f"{root}/{name}/{version}/model"
    try:
        return ForestModel.load(SparkSession.active(), path)
    except AnalysisException:  # no forest lies there
        return PipelineModel.load(path)


def list_models(spark, root: str) -> DataFrame:
    return spark.read.schema("name string, version string, facts string").json(f"{root}/*/*/manifest")


# -- experiments -------------------------------------------------------------------
def train_and_judge(train: DataFrame, test: DataFrame, estimator, label: str = "y") -> DataFrame:
    """One report row: the averages of D28 for a model fitted on ``train``."""
    judged = predict(fit_classifier(train, label, estimator), test)
    return A.averages(A.per_class(A.pair_counts(judged, true=label)))


def _tagged(reports: Sequence[tuple[str, DataFrame]], name: str) -> DataFrame:
    out = None
    for tag, report in reports:
        row = report.withColumn(name, F.lit(tag))
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(train: DataFrame, test: DataFrame, estimators: dict[str, object], label: str = "y") -> DataFrame:
    """K16."""
    return _tagged([(n, cut_lineage(train_and_judge(train, test, e, label))) for n, e in estimators.items()], "model")


def group_ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[int]], column: str,
                   make: Callable[[], object], label: str = "y") -> DataFrame:
    """Zero one group of features in both parts, fit again, report the change of the macro averages."""
    def without(rows: DataFrame, dims: Sequence[int]) -> DataFrame:
        zero = F.transform(F.col(column).cast("array<double>"),
                           lambda v, i: F.when(i.isin(*dims), 0.0).otherwise(v))
        return vectors(rows.withColumn(column, zero), [column])

    metrics = ["precision_macro", "recall_macro", "f1_macro"]
    full = train_and_judge(vectors(train, [column]), vectors(test, [column]), make(), label)
    base = full.select(*[F.col(m).alias(f"full_{m}") for m in metrics])
    from quietwire.operators.clock import with_scalars

    out = _tagged([(g, train_and_judge(without(train, d), without(test, d), make(), label)) for g, d in groups.items()], "feature_group")
    return with_scalars(out, base).select("feature_group", *metrics, *[(F.col(m) - F.col(f"full_{m}")).alias(f"delta_{m}") for m in metrics])


def scenarios_of(rows: DataFrame, label: str = "y", scenario: str = "scenario") -> list[str]:
    """The scenarios found in the rows that can be held out: the rest still has two classes or more."""
    pairs = [(r[scenario], r[label]) for r in rows.select(scenario, label).distinct().collect()]  # scenarios x classes
    names = sorted({s for s, _ in pairs if s is not None})
    return [s for s in names if len({y for other, y in pairs if other != s}) >= 2]


def scenario_holdout(rows: DataFrame, make: Callable[[], object], label: str = "y", scenario: str = "scenario") -> DataFrame:
    """Fit without a scenario and judge on it, for each scenario that the rows hold; those that leave one class are skipped."""
    scenarios = scenarios_of(rows, label, scenario)
    return _tagged([(s, train_and_judge(rows.filter(F.col(scenario) != s), rows.filter(F.col(scenario) == s), make(), label))
                    for s in scenarios], "held_out")


def seed_stability(train: DataFrame, test: DataFrame, make: Callable[[int], object], seeds: Sequence[int] = (42, 43, 44, 45, 46),
                   label: str = "y") -> DataFrame:
    """Spread of the macro F1 over seeds.

    Each report is stored before the next model is fitted, so that one model at a time is held.
    """
    runs = _tagged([(str(s), cut_lineage(train_and_judge(train, test, make(s), label))) for s in seeds], "seed")
    return A.spread_of(runs, "f1_macro")


def known_against_unseen(train: DataFrame, validation: DataFrame, test: DataFrame, column: str, identity: str,
                         make: Callable[[], object], benign: str, trees: int = 100) -> DataFrame:
    """Classifier and anomaly detector on a held-out scenario, side by side.

    The forest sees benign rows only; its threshold is chosen on the validation rows.
    """
    forest = fit_isolation_forest(train.filter(F.col("y") == benign), [column], identity, trees=trees)
    binary = (F.col("y") != benign).cast("int")

    def scored(rows: DataFrame) -> DataFrame:
        return anomaly_scores(rows, forest, [column]).select(binary.alias("y"), "score")

    chosen = A.best_threshold(A.threshold_report(scored(validation), A.SWEEP)).select("threshold")
    from quietwire.operators.clock import with_scalars

    held = with_scalars(scored(test), chosen)

    def judged(threshold: Column, prefix: str) -> DataFrame:
        hit = (F.col("score") >= threshold).cast("int")
        counts = held.agg(F.sum(hit * F.col("y")).alias("tp"), F.sum(hit * (1 - F.col("y"))).alias("fp"),
                          F.sum("y").alias("tp_all"), F.sum(1 - F.col("y")).alias("fp_all"), F.first("threshold").alias("threshold"))
        return A.rates(counts).select(F.col("threshold").alias("_t"), F.col("f1").alias(f"{prefix}_f1"), F.col("recall").alias(f"{prefix}_recall"), F.col("fpr").alias(f"{prefix}_fpr"))

    anomaly = with_scalars(judged(F.col("threshold"), "anomaly").withColumnRenamed("_t", "threshold"), judged(F.lit(0.5), "default").drop("_t"))
    known = train_and_judge(vectors(train, [column]), vectors(test, [column]), make()).select(
        F.col("accuracy").alias("classifier_accuracy"), F.col("f1_macro").alias("classifier_f1_macro"))
    return with_scalars(known, anomaly)


def leave_one_scenario_out(rows: DataFrame, column: str, identity: str, make: Callable[[], object], benign: str, trees: int = 100,
                           scenario: str = "scenario") -> DataFrame:
    """Both detectors on every scenario in turn; the next one chooses the threshold, the others are learnt from."""
    names = scenarios_of(rows, scenario=scenario)
    reports = []
    for place, held in enumerate(names):
        chooses = names[(place + 1) % len(names)]
        rest = rows.filter(~F.col(scenario).isin(held, chooses))
        reports.append((held, known_against_unseen(rest, rows.filter(F.col(scenario) == chooses), rows.filter(F.col(scenario) == held), column, identity, make, benign, trees)))
    return _tagged(reports, "held_out")
