"""Queries that fit and apply models (checked by row shape and by tests, not by SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.operators import detect as D
from quietwire.operators import models as M
from quietwire.operators.evaluate import averages, pair_counts, per_class
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded

B.SQL_VIEWS["both_models"] = (("multi2",), "select 'first' as model, y, pred from multi2 union all select 'second', y, pred_after from multi2")
DIMS = [f"d{i}" for i in range(64)]


def rows_of(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("row_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("y"),
                    F.col("embedding").cast("array<double>").alias("x"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("scenario"))


def halves(spark, sf):
    rows = rows_of(spark, sf)
    return rows.filter("row_id % 4 <> 0"), rows.filter("row_id % 4 = 0")


def _linear():
    return M.logistic()


_REST = "case when {n} > 2 then 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::double when {n} = 2 then 1.0 else 0.0 end"
_DRAW = "(('0x' || substr(md5('42:' || tree || ':' || node || ':{turn}'), 1, 8))::bigint / 4294967296.0::double)"
#: The forest grown in SQL: 100 trees of up to 256 benign rows, each row carried from node to node, and every row walked down every tree.
_FOREST_SQL = f"""
with recursive base as materialized (select vec_id::bigint as row_id, 'c'||label as y, list_transform(embedding, lambda v: v::double) as x from embeddings),
pool as materialized (select * from base where y = 'c0' order by md5(row_id||'#42'), row_id limit 25600),
taken as materialized (select tree, row_id, x from (select t.tree, p.row_id, p.x, row_number() over (partition by t.tree order by md5(t.tree||':'||p.row_id||'#42'), p.row_id) as rn
 from pool p, range(100) t(tree)) where rn <= 256),
depths as materialized (select count(*) as psi, ceil(log2(greatest(count(*), 2)))::int as top from taken where tree = 0),
grown as (select tree, row_id, x, 0::bigint as node, 0 as depth, null::int as f, null::double as cut, false as done from taken
 union all
 select g.tree, g.row_id, g.x, 2 * g.node + case when g.x[s.f + 1] < s.cut then 1 else 2 end, g.depth + 1, null, null, false
 from grown g join (
  select tree, node, pick.d as f, pick.lo + {_DRAW.format(turn=1)} * (pick.hi - pick.lo) as cut from (
   select tree, node, u[1 + floor({_DRAW.format(turn=0)} * len(u))::int] as pick from (
    select tree, node, list({{'d': d, 'lo': lo, 'hi': hi}} order by d) as u from (
     select tree, node, d, min(v) as lo, max(v) as hi from (
      select tree, node, unnest(range(len(x)))::int as d, unnest(x) as v from grown, depths where depth < top) group by all having min(v) < max(v)) group by all))) s
 on s.tree = g.tree and s.node = g.node),
nodes as materialized (select tree, node, depth, count(*) as n from grown group by all),
splits as materialized (
 select tree, node, pick.d as f, pick.lo + {_DRAW.format(turn=1)} * (pick.hi - pick.lo) as cut from (
  select tree, node, u[1 + floor({_DRAW.format(turn=0)} * len(u))::int] as pick from (
   select tree, node, list({{'d': d, 'lo': lo, 'hi': hi}} order by d) as u from (
    select tree, node, d, min(v) as lo, max(v) as hi from (
     select tree, node, unnest(range(len(x)))::int as d, unnest(x) as v from grown, depths where depth < top) group by all having min(v) < max(v)) group by all))),
walk as (select row_id, x, t.tree, 0::bigint as node, 0 as depth from base, (select distinct tree from taken) t
 union all
 select w.row_id, w.x, w.tree, 2 * w.node + case when w.x[s.f + 1] < s.cut then 1 else 2 end, w.depth + 1 from walk w join splits s on s.tree = w.tree and s.node = w.node),
ends as (select w.row_id, avg(w.depth + {_REST.format(n="coalesce(n.n, 0)")}) as path
 from walk w left join nodes n on n.tree = w.tree and n.node = w.node where not exists (select 1 from splits s where s.tree = w.tree and s.node = w.node) group by 1),
scores as (select row_id, y, least(greatest(pow(2.0, -path / greatest((select {_REST.format(n="psi")} from depths), 1e-12)), 0.0), 1.0) as score from ends join base using (row_id))
select y, count(*) as n, round(avg(score), 6) + 0.0 as mean_score, round(max(score), 6) + 0.0 as top_score from scores group by y"""


@query("isolation_scores", _FOREST_SQL)
def isolation_scores(spark, sf):
    """Forest of the benign rows, scores of all rows."""
    rows = rows_of(spark, sf)
    forest = M.fit_isolation_forest(rows.filter("y = 'c0'"), ["x"], "row_id")
    out = M.anomaly_scores(rows, forest, ["x"])
    return rounded(out.groupBy("y").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("top_score")))


@query("logistic_predictions")
def logistic_predictions(spark, sf):
    """K8, K11."""
    train, test = halves(spark, sf)
    model = M.fit_classifier(M.vectors(train, ["x"]), "y", _linear())
    return M.predict(model, M.vectors(test, ["x"])).groupBy("y", "pred").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


@query("model_comparison")
def model_comparison(spark, sf):
    """Three kinds of model on the same rows, each with its defaults (the boosted one is one ensemble per class)."""
    train, test = (M.vectors(h, ["x"]) for h in halves(spark, sf))
    kinds = {"logistic": _linear(), "forest": M.random_forest(), "boosted": M.boosted()}
    return M.compare_models(train, test, kinds)


@query("linear_attribution")
def linear_attribution(spark, sf):
    """Mean absolute contribution of every dimension per predicted class."""
    train, test = halves(spark, sf)
    model = M.fit_classifier(M.vectors(train, ["x"]), "y", _linear())
    parts = M.linear_contributions(model, M.vectors(test, ["x"]), DIMS, ["row_id"])
    return parts.groupBy("pred", "feature_name").agg(F.avg(F.abs("contribution")).alias("weight"), F.count("*").alias("n"))


@query("group_ablation")
def group_ablation(spark, sf):
    """K17."""
    train, test = halves(spark, sf)
    groups = {f"group_{g}": list(range(64 * g // 7, 64 * (g + 1) // 7)) for g in range(7)}
    return M.group_ablation(train, test, groups, "x", _linear)


@query("scenario_holdout")
def scenario_holdout(spark, sf):
    """K19."""
    rows = M.vectors(rows_of(spark, sf), ["x"])
    return M.scenario_holdout(rows, _linear)


@query("seed_stability")
def seed_stability(spark, sf):
    """K21, D51."""
    train, test = (M.vectors(h, ["x"]) for h in halves(spark, sf))
    return M.seed_stability(train, test, lambda s: M.random_forest(seed=s))


@query("known_against_unseen")
def known_against_unseen(spark, sf):
    """Every scenario held out once."""
    return M.leave_one_scenario_out(rows_of(spark, sf), "x", "row_id", _linear, "c0")


def _statistics(spark, sf):
    return B.stored(spark, sf, "scaling", lambda: D.scaling_statistics(B.stored_features(spark, sf)))


def _scaled(spark, sf):
    """The standardised flows, stored: a fit reads them several times, and every reading would work out the exact medians and scale all rows anew."""
    def build():
        rows = D.standardise(B.stored_features(spark, sf), _statistics(spark, sf))
        return rows.select("flow_id", "label", *S.LINEAR_FEATURES)

    return B.stored(spark, sf, "scaled", build)


@query("flow_detections")
def flow_detections(spark, sf):
    """Features to scaled rows to forest and classifier to detections."""
    def build():
        rows = _scaled(spark, sf)
        forest = M.fit_isolation_forest(D.benign_only(rows), S.LINEAR_FEATURES, "flow_id")
        ready = M.vectors(rows, S.LINEAR_FEATURES).withColumn("y", F.col("label"))
        model = M.fit_classifier(ready, "y", _linear())
        scored = M.anomaly_scores(M.predict(model, ready), forest, S.LINEAR_FEATURES)
        return D.detections(scored).select("flow_id", "label", "score", "severity", "is_anomalous", "classification_score_class",
                                           "threat_type", "confidence", "rationale")

    out = B.stored(spark, sf, "detections", build)
    return out.groupBy("threat_type", "severity", "is_anomalous").agg(F.count("*").alias("flows"), F.avg("confidence").alias("confidence"))


@query("probe_scores")
def probe_scores(spark, sf):
    """Probes built from the statistics of the flows, scored by their forest."""
    rows = B.stored_features(spark, sf)
    stats = D.training_statistics(rows)
    forest = M.fit_isolation_forest(rows, S.FEATURES, "flow_id")
    return D.probe_summary(M.anomaly_scores(D.probes(stats), forest, S.FEATURES))


@query("perturbed_detections")
def perturbed_detections(spark, sf):
    """How many predictions a noisy measurement changes."""
    rows = B.stored_features(spark, sf)
    ready = lambda r: M.vectors(r, S.LINEAR_FEATURES).withColumn("y", F.col("label"))
    plain = ready(_scaled(spark, sf))
    model = M.fit_classifier(plain, "y", _linear())
    noisy = D.standardise(D.size_noise(D.timing_jitter(rows, "flow_id"), "flow_id", noise=50.0), _statistics(spark, sf))
    before = M.predict(model, plain).select(F.col("flow_id").alias("row_id"), "pred", "confidence", "y")
    after = M.predict(model, ready(noisy)).select(F.col("flow_id").alias("row_id"), "pred", "confidence")
    from quietwire.operators.evaluate import change_summary, changed_predictions

    return change_summary(changed_predictions(before, after))


@query("class_reports_by_model", B.with_views("""
select model, metric, round(value,6)+0.0 as value from (
 unpivot (select model, sum(tp)::double/sum(support) as accuracy, avg(f1) as f1_macro, sum(f1*support)::double/sum(support) as f1_weighted from (
  select *, case when pr+rc=0 then 0 else 2*pr*rc/(pr+rc) end as f1 from (
   select *, case when predicted=0 then 0 else tp::double/predicted end as pr, case when support=0 then 0 else tp::double/support end as rc from (
    select model, label, sum(s) as support, sum(p) as predicted, sum(t) as tp from (
     select model, y as label, 1 as s, 0 as p, (y=pred)::int as t from both_models union all select model, pred, 0, 1, 0 from both_models) group by all))) group by model)
 on accuracy, f1_macro, f1_weighted into name metric value value)""", "both_models"))
def class_reports_by_model(spark, sf):
    """Per-model averages of two stored predictions in long form."""
    from quietwire.operators.evaluate import metric_rows
    from quietwire.plans.evaluation_queries import after

    first = B.multi(spark, sf)
    second = first.drop("pred", "confidence").join(after(spark, sf), "row_id")
    both = first.withColumn("model", F.lit("first")).unionByName(second.withColumn("model", F.lit("second")), allowMissingColumns=True)
    report = averages(per_class(pair_counts(both, ["model"]), ["model"]), ["model"])
    return rounded(metric_rows(report, ["model"], ["accuracy", "f1_macro", "f1_weighted"]))
