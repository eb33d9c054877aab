"""Queries that judge models and split datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.operators import evaluate as A
from quietwire.operators import splits as L
from quietwire.operators.clock import exact_quantiles
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded

BENIGN = "c0"


def _list(values):
    return "[" + ",".join(f"{v!r}::double" for v in values) + "]"


def r(*names):
    return ", ".join(f"round({n},6)+0.0 as {n}" for n in names)


V = B.SQL_VIEWS
V["pairs"] = (("multi",), "select y, pred, count(*) as n from multi group by all")
V["labels_all"] = (("pairs",), "select y as label from pairs union select pred from pairs")
V["cls"] = (("pairs", "labels_all"), """
select label, support::bigint as support, predicted::bigint as predicted, tp::bigint as tp, total::bigint as total,
 case when predicted=0 then 0.0 else tp/predicted end as precision, case when support=0 then 0.0 else tp/support end as recall,
 case when support+predicted=0 then 0.0 else 2*tp/(support+predicted) end as f1,
 case when total-support=0 then 0.0 else (predicted-tp)/(total-support) end as fpr, case when support=0 then 0.0 else (support-tp)/support end as fnr
from (select label, (select coalesce(sum(n),0) from pairs where y=label) as support, (select coalesce(sum(n),0) from pairs where pred=label) as predicted,
  (select coalesce(sum(n),0) from pairs where y=label and pred=label) as tp, (select sum(n) from pairs) as total from labels_all)""")
V["sweep"] = (("scored",), f"""
select threshold, tp, fp, fn, tn, precision, recall, case when precision+recall=0 then 0.0 else 2*precision*recall/(precision+recall) end as f1, fpr, fnr from (
 select *, case when tp+fp=0 then 0.0 else tp/(tp+fp) end as precision, case when tp+fn=0 then 0.0 else tp/(tp+fn) end as recall,
  case when fp+tn=0 then 0.0 else fp/(fp+tn) end as fpr, case when tp+fn=0 then 0.0 else fn/(tp+fn) end as fnr from (
  select t as threshold, count(*) filter (score>=t and y=1) as tp, count(*) filter (score>=t and y=0) as fp,
   count(*) filter (score<t and y=1) as fn, count(*) filter (score<t and y=0) as tn
  from scored, (select unnest({_list(A.SWEEP)}) as t) group by t))""")
V["curve"] = (("scored",), """
select score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, (select sum(y) from scored) as P, (select count(*)-sum(y) from scored) as N
from (select score, sum(y) as pos, count(*)-sum(y) as neg from scored group by score) window w as (order by score desc)""")
V["multi2"] = ((), """
select vec_id::bigint as row_id, 'c'||label as y, 'c'||((list_position(embedding, list_max(embedding))-1)%10) as pred, list_max(embedding)::double as confidence,
 'c'||((list_position(embedding, list_min(embedding))-1)%10) as pred_after, -list_min(embedding)::double as confidence_after from embeddings""")
V["fused_in"] = (("scored",), "select *, case when y=0 then 'benign' else (['ddos','c2','reconnaissance','dns_tunneling'])[(row_id//5)%4+1] end as y_true from scored")
V["taus"] = (("fused_in",), f"""
select (select t from (select t, count(*) filter (confidence>=t and pred=y_true and y_true<>'benign') as good, count(*) filter (confidence>=t) as ab, count(*) as al
   from fused_in, (select unnest({_list(A.CONFIDENCE_SWEEP)}) as t) where pred<>'benign' group by t) where ab>0
   order by 2*(good/ab)*(ab/al)/((good/ab)+(ab/al)) desc, t limit 1) as tau_known,
 (select t from (select t, count(*) filter (score>=t and y=1) as tp, count(*) filter (score>=t) as pp, sum(y) as p
   from fused_in, (select unnest({_list(A.ANOMALY_SWEEP)}) as t) group by t) order by 2*tp/(pp+p) desc, t limit 1) as tau_anomaly,
 (select quantile_cont(score,0.25) from fused_in where y_true='benign') as tau_benign""")
V["fused"] = (("fused_in", "taus"), """
select *, case when pred<>'benign' and confidence>=tau_known then 'KNOWN_ATTACK' when score>=tau_anomaly then 'NOVEL_ANOMALY'
 when pred='benign' and score<tau_benign then 'BENIGN' else 'UNCERTAIN' end as category from fused_in, taus""")
V["fam"] = ((), "select vec_id::bigint as row_id, 'c'||label as y, 's'||((label%4)*2+vec_id%2) as scenario from embeddings")


def fused_rows(spark, sf):
    kinds = F.array(*[F.lit(t) for t in B.EVENT_TYPES[1:]])
    return B.scored(spark, sf).withColumn("y_true", F.when(F.col("y") == 0, "benign").otherwise(
        F.element_at(kinds, (F.floor(F.col("row_id") / 5) % 4 + 1).cast("int"))))


def after(spark, sf):
    """A second prediction of the same rows: the place of the smallest entry, modulo ten classes."""
    e = B.table(spark, sf, "embeddings")
    least = F.array_min("embedding")
    return e.select(F.col("vec_id").cast("long").alias("row_id"),
                    F.concat(F.lit("c"), ((F.array_position("embedding", least) - 1) % 10).cast("string")).alias("pred"),
                    (-least).cast("double").alias("confidence"))


def family_rows(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("row_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("y"),
                    F.concat(F.lit("s"), ((F.col("label") % 4) * 2 + F.col("vec_id") % 2).cast("string")).alias("scenario"))


@query("class_distribution", B.with_views(f"select y, n, round(n/sum(n) over (),6)+0.0 as proportion, round(max(n) over ()/min(n) over (),6)+0.0 as imbalance_ratio from (select y, count(*) as n from multi group by y)", "multi"))
def class_distribution(spark, sf):
    """D25."""
    return rounded(A.class_distribution(B.multi(spark, sf), "y"))


@query("confusion_matrix", B.with_views("select a.label as y, b.label as pred, coalesce(n,0) as n from labels_all a cross join labels_all b left join pairs p on p.y=a.label and p.pred=b.label", "labels_all"))
def confusion_matrix(spark, sf):
    """D26, A14."""
    return A.confusion(A.pair_counts(B.multi(spark, sf)))


@query("per_class_metrics", B.with_views(f"select label, support, predicted, tp, {r('precision','recall','f1','fpr','fnr')} from cls", "cls"))
def per_class_metrics(spark, sf):
    """D27."""
    return rounded(A.per_class(A.pair_counts(B.multi(spark, sf))).drop("total"))


@query("average_metrics", B.with_views("""
select round(sum(tp)/sum(support),6)+0.0 as accuracy, sum(support)::bigint as n, round(avg(precision),6)+0.0 as precision_macro, round(avg(recall),6)+0.0 as recall_macro,
 round(avg(f1),6)+0.0 as f1_macro, round(sum(precision*support/total),6)+0.0 as precision_weighted, round(sum(recall*support/total),6)+0.0 as recall_weighted,
 round(sum(f1*support/total),6)+0.0 as f1_weighted from cls""", "cls"))
def average_metrics(spark, sf):
    """D28."""
    return rounded(A.averages(A.per_class(A.pair_counts(B.multi(spark, sf)))))


@query("metrics_by_scenario", B.with_views("select scenario, count(*) as n, round(avg((y=pred)::int),6)+0.0 as accuracy from multi group by all", "multi"))
def metrics_by_scenario(spark, sf):
    """One report per group from a single aggregation."""
    pairs = A.pair_counts(B.multi(spark, sf), ["scenario"])
    return rounded(A.averages(A.per_class(pairs, ["scenario"]), ["scenario"]).select("scenario", "n", "accuracy"))


@query("binary_metrics", B.with_views(f"""
select tp, fp, fn, tn, {r('precision','recall')}, round(2*precision*recall/(precision+recall),6)+0.0 as f1, round(fp/(fp+tn),6)+0.0 as fpr, round(fn/(tp+fn),6)+0.0 as fnr
from (select *, tp/(tp+fp) as precision, tp/(tp+fn) as recall from (select count(*) filter (score>=0.5 and y=1) as tp, count(*) filter (score>=0.5 and y=0) as fp,
 count(*) filter (score<0.5 and y=1) as fn, count(*) filter (score<0.5 and y=0) as tn from scored))""", "scored"))
def binary_metrics(spark, sf):
    """D29."""
    return rounded(A.threshold_report(B.scored(spark, sf), [0.5]).drop("threshold"))


@query("threshold_sweep", B.with_views(f"select {r('threshold')}, tp, fp, fn, tn, {r('precision','recall','f1','fpr','fnr')} from sweep", "sweep"))
def threshold_sweep(spark, sf):
    """D33."""
    return rounded(A.threshold_report(B.scored(spark, sf), A.SWEEP))


@query("best_threshold", B.with_views("select round(threshold,6) as threshold, round(f1,6) as objective from sweep order by f1 desc, threshold limit 1", "sweep"))
def best_threshold(spark, sf):
    """D33."""
    return rounded(A.best_threshold(A.threshold_report(B.scored(spark, sf), A.SWEEP)))


@query("score_curve", B.with_views("select score, tp::bigint as tp, fp::bigint as fp from curve", "curve"))
def score_curve(spark, sf):
    """E10."""
    return A.score_curve(B.scored(spark, sf)).select("score", "tp", "fp")


@query("curve_areas", B.with_views("""
select round(sum(neg*(tp-pos/2.0))/max(P*N),6)+0.0 as roc_auc,
 round(sum(pos*(tp/(tp+fp)+case when tp-pos+fp-neg=0 then 1.0 else (tp-pos)/(tp-pos+fp-neg) end)/2)/max(P),6)+0.0 as pr_auc,
 round(sum(pos*tp/(tp+fp))/max(P),6)+0.0 as average_precision, max(P)::bigint as positives, max(N)::bigint as negatives from curve""", "curve"))
def curve_areas(spark, sf):
    """D30, D31, D32."""
    return rounded(A.curve_areas(A.score_curve(B.scored(spark, sf))))


def _of_class(i):
    """Which places of a vector speak for class ``i``."""
    return lambda x, k: k % 10 == i


@query("one_vs_rest_areas", """
select label, round((sum(case when y then rk else 0 end) - p*(p+1)/2.0)/(p*n),6)+0.0 as roc_auc from (
 select label, y, sum(y::int) over (partition by label) as p, sum((not y)::int) over (partition by label) as n,
  rank() over (partition by label order by s) + (count(*) over (partition by label, s) - 1)/2.0 as rk
 from (select 'c'||g.i as label, label=g.i as y, list_max(list_filter(embedding, lambda x, k: (k-1)%10=g.i))::double as s from embeddings, (select unnest(range(10)) as i) g)) group by label, p, n""")
def one_vs_rest_areas(spark, sf):
    """Area per class against the rest, all classes in one pass."""
    best = F.array(*[F.array_max(F.filter("embedding", _of_class(i))) for i in range(10)])
    e = B.table(spark, sf, "embeddings").select("label", F.posexplode(best).alias("i", "score"))
    rows = e.select(F.concat(F.lit("c"), F.col("i").cast("string")).alias("class"),
                    (F.col("label") == F.col("i")).cast("int").alias("y"), F.col("score").cast("double").alias("score"))
    out = A.curve_areas(A.score_curve(rows, keys=["class"]), ["class"])
    return rounded(out.select(F.col("class").alias("label"), "roc_auc"))


@query("recall_at_fpr", B.with_views("""
select target_fpr, round(fp/N,6)+0.0 as actual_fpr, round(tp/P,6)+0.0 as recall, round(score,6)+0.0 as threshold from (
 select *, row_number() over (partition by target_fpr order by abs(fp/N-target_fpr), score desc) as rn from curve, (select unnest([0.01::double,0.05::double]) as target_fpr)) where rn=1""", "curve"))
def recall_at_fpr(spark, sf):
    """D37."""
    return rounded(A.recall_at_fpr(A.score_curve(B.scored(spark, sf)), [0.01, 0.05]))


@query("curve_sample", B.with_views("""
select round(fp/N,6)+0.0 as fpr, round(tp/P,6)+0.0 as tpr, score from (select *, row_number() over (order by score desc) - 1 as place, count(*) over () as size from curve)
where size <= 50 or place in (select (i*(s-1))//49 from (select unnest(range(50)) as i), (select count(*) as s from curve))""", "curve"))
def curve_sample(spark, sf):
    """Fifty points of the curve."""
    return rounded(A.sampled_curve(A.score_curve(B.scored(spark, sf)), 50))


_QS = ", ".join(f"round(quantile_cont(score,{q}),6)+0.0 as {n}" for n, q in A.STAT_QUANTILES.items())


@query("score_statistics", B.with_views(f"""
select y, count(*) as n, round(avg(score),6)+0.0 as mean, round(stddev_pop(score),6)+0.0 as std, round(min(score),6)+0.0 as min, round(max(score),6)+0.0 as max, {_QS} from scored group by y""", "scored"))
def score_statistics(spark, sf):
    """D39."""
    return rounded(A.score_statistics(B.scored(spark, sf), ["y"]))


@query("novelty_ranking", B.with_views("""
select round(b,6)+0.0 as benign_median, round(a,6)+0.0 as attack_median, round(a-b,6)+0.0 as median_separation,
 (select round(sum(neg*(tp-pos/2.0))/max(P*N),6)+0.0 from curve) as roc_auc, (select round(sum(pos*tp/(tp+fp))/max(P),6)+0.0 from curve) as average_precision
from (select quantile_cont(score,0.5) filter (y=0) as b, quantile_cont(score,0.5) filter (y=1) as a from scored)""", "scored", "curve"))
def novelty_ranking(spark, sf):
    """D40."""
    return rounded(A.novelty_ranking(B.scored(spark, sf)).drop("pr_auc", "positives", "negatives"))


@query("calibration_error", B.with_views(f"""
select round(sum(abs(o-p)*c)/sum(c),6)+0.0 as ece, sum(c)::bigint as n, (select round(avg(pow(score-y,2)),6)+0.0 from scored) as brier from (
 select b, count(*) as c, avg(y) as o, avg(score) as p from (select *, len(list_filter({_list(A.BIN_EDGES[1:-1])}, lambda e: e <= score)) as b from scored) group by b)""", "scored"))
def calibration_error(spark, sf):
    """D41, D42."""
    s = B.scored(spark, sf)
    from quietwire.operators.clock import with_scalars

    return rounded(with_scalars(A.calibration_error(A.reliability(s)), s.agg(A.brier(s).alias("brier"))))


@query("reliability_bins", B.with_views(f"""
select i::int as bin, coalesce(c,0) as count, round(coalesce(o,0),6)+0.0 as observed_frequency, round(coalesce(p,0),6)+0.0 as predicted_mean from (select unnest(range(10)) as i)
left join (select b, count(*) as c, avg(y) as o, avg(score) as p from (select *, len(list_filter({_list(A.BIN_EDGES[1:-1])}, lambda e: e <= score)) as b from scored) group by b) on b=i""", "scored"))
def reliability_bins(spark, sf):
    """D42."""
    return rounded(A.reliability(B.scored(spark, sf)).drop("bin_center"))


@query("calibration_gate", B.with_views("""
select model, count(*) as n, case when model<>'isolation_forest' then round(avg(pow(score-y,2)),6)+0.0 end as brier, model<>'isolation_forest' as applicable
from (select *, case when row_id%3=0 then 'isolation_forest' when row_id%3=1 then 'forest' else 'logistic' end as model from scored) group by model""", "scored"))
def calibration_gate(spark, sf):
    """D43."""
    third = F.col("row_id") % 3
    rows = B.scored(spark, sf).withColumn("model", F.when(third == 0, "isolation_forest").when(third == 1, "forest").otherwise("logistic"))
    return rounded(A.calibration_gate(rows, "model"))


@query("false_positives_by_scenario", B.with_views("""
select scenario, count(*) filter (y=0 and score>=0.4) as false_positives, count(*) filter (y=0) as total_benign,
 round(count(*) filter (y=0 and score>=0.4)/greatest(count(*) filter (y=0),1),6)+0.0 as fp_rate from scored group by all""", "scored"))
def false_positives_by_scenario(spark, sf):
    """D38."""
    return rounded(A.false_positives_by(B.scored(spark, sf), "scenario", 0.4))


@query("false_positive_ranges", B.with_views("""
select r as score_range, count(score) as false_positives from (values ('0.0-0.4',0.0,0.4),('0.4-0.5',0.4,0.5),('0.5-0.6',0.5,0.6),('0.6-0.7',0.6,0.7),('0.7-1.0',0.7,1.0)) v(r,lo,hi)
left join (select score from scored where y=0 and score>=0.4) s on score>=lo::double and score<hi::double group by r""", "scored"))
def false_positive_ranges(spark, sf):
    """D38."""
    return A.false_positive_ranges(B.scored(spark, sf), 0.4)


@query("fusion_thresholds", B.with_views(f"select {r('tau_known','tau_anomaly','tau_benign')} from taus", "taus"))
def fusion_thresholds(spark, sf):
    """D34."""
    return rounded(A.fusion_thresholds(fused_rows(spark, sf)))


@query("fusion_categories", B.with_views("select row_id, category from fused", "fused"))
def fusion_categories(spark, sf):
    """D35."""
    rows = fused_rows(spark, sf)
    return A.fusion_category(rows, A.fusion_thresholds(rows)).select("row_id", "category")


@query("fusion_report", B.with_views("""
select tp_known_attack, tp_novel_anomaly, tn_benign, fp_known, fp_novel, fn_missed_as_benign, n_uncertain, n_total, round(p,6)+0.0 as binary_precision,
 round(q,6)+0.0 as binary_recall, round(case when p+q=0 then 0 else 2*p*q/(p+q) end,6)+0.0 as binary_f1 from (
 select *, coalesce(hit/nullif(found,0),0.0) as p, coalesce(hit/nullif(att,0),0.0) as q from (
 select count(*) filter (category='KNOWN_ATTACK' and y_true in ('ddos','c2')) as tp_known_attack, count(*) filter (category='NOVEL_ANOMALY' and y_true<>'benign') as tp_novel_anomaly,
 count(*) filter (category='BENIGN' and y_true='benign') as tn_benign, count(*) filter (category='KNOWN_ATTACK' and y_true='benign') as fp_known,
 count(*) filter (category='NOVEL_ANOMALY' and y_true='benign') as fp_novel, count(*) filter (category='BENIGN' and y_true<>'benign') as fn_missed_as_benign,
 count(*) filter (category='UNCERTAIN') as n_uncertain, count(*) as n_total, count(*) filter (category in ('KNOWN_ATTACK','NOVEL_ANOMALY') and y_true<>'benign') as hit,
 count(*) filter (category in ('KNOWN_ATTACK','NOVEL_ANOMALY')) as found, count(*) filter (y_true<>'benign') as att from fused))""", "fused"))
def fusion_report(spark, sf):
    """D36."""
    rows = fused_rows(spark, sf)
    return rounded(A.fusion_report(A.fusion_category(rows, A.fusion_thresholds(rows)), ["ddos", "c2"]))


@query("missed_by_class", B.with_views("""
select y, count(*) as total_samples, count(*) filter (pred='c0') as false_negatives, round(count(*) filter (pred='c0')/count(*),6)+0.0 as miss_rate from multi where y<>'c0' group by y""", "multi"))
def missed_by_class(spark, sf):
    """D44."""
    return rounded(A.missed_by_class(A.pair_counts(B.multi(spark, sf)), BENIGN))


@query("missed_samples", B.with_views("""
select y, row_id, rn as place from (select *, row_number() over (partition by y order by row_id) as rn from multi where y<>'c0' and pred='c0') where rn <= 10""", "multi"))
def missed_samples(spark, sf):
    """D44."""
    return A.missed_samples(B.multi(spark, sf), BENIGN).select("y", "row_id", "place")


@query("benign_to_malicious", B.with_views("""
select pred, count(*) as n, round(count(*)/(select count(*) from multi where y='c0'),6)+0.0 as share from multi where y='c0' and pred<>'c0' group by pred""", "multi"))
def benign_to_malicious(spark, sf):
    """D55."""
    return rounded(A.false_alarm_classes(A.pair_counts(B.multi(spark, sf)), BENIGN))


@query("attack_prevalence", B.with_views("select count(*) as n, round(avg((y<>'c0')::int),6)+0.0 as prevalence from multi", "multi"))
def attack_prevalence(spark, sf):
    """D61."""
    return rounded(A.prevalence(B.multi(spark, sf), BENIGN))


@query("prediction_changes", B.with_views("""
select count(*) as n, count(*) filter (pred<>pred_after) as changed, round(count(*) filter (pred<>pred_after)*100.0/count(*),6)+0.0 as changed_pct,
 round(avg(abs(confidence_after-confidence)),6)+0.0 as mean_change, round(max(abs(confidence_after-confidence)),6)+0.0 as max_change from multi2""", "multi2"))
def prediction_changes(spark, sf):
    """C12, D50."""
    return rounded(A.change_summary(A.changed_predictions(B.multi(spark, sf), after(spark, sf))))


@query("recall_changes", B.with_views("""
select y, count(*) as support, round(avg((pred=y)::int),6)+0.0 as recall_before, round(avg((pred_after=y)::int),6)+0.0 as recall_after,
 round(avg((pred_after=y)::int)-avg((pred=y)::int),6)+0.0 as recall_change from multi2 group by y""", "multi2"))
def recall_changes(spark, sf):
    """D49."""
    return rounded(A.recall_change(A.changed_predictions(B.multi(spark, sf), after(spark, sf))))


@query("metric_deltas", B.with_views("""
select y as model, metric, round(a,6)+0.0 as old, round(b,6)+0.0 as new, round(b-a,6)+0.0 as delta from (
 select y, 'recall' as metric, avg((pred=y)::int) as a, avg((pred_after=y)::int) as b from multi2 group by y
 union all select y, 'mean_confidence', avg(confidence), avg(confidence_after) from multi2 group by y)""", "multi2"))
def metric_deltas(spark, sf):
    """C15, K27."""
    both = A.changed_predictions(B.multi(spark, sf), after(spark, sf)).withColumnRenamed("y", "model")

    def report(pred, confidence):
        hit = (F.col(pred) == F.col("model")).cast("double")
        wide = both.groupBy("model").agg(F.avg(hit).alias("recall"), F.avg(confidence).alias("mean_confidence"))
        return A.metric_rows(wide, ["model"], ["recall", "mean_confidence"])

    return rounded(A.metric_delta(report("pred", "confidence"), report("pred_after", "confidence_after"), ["model"]))


@query("family_comparison", B.with_views("""
select y, round(avg((pred=y)::int),6)+0.0 as supervised, round(avg((confidence>=0.3)::int),6)+0.0 as anomaly from multi where y<>'c0' group by y""", "multi"))
def family_comparison(spark, sf):
    """C16."""
    rows = B.multi(spark, sf).filter(F.col("y") != BENIGN)
    long = rows.groupBy("y").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("supervised"),
                                 F.avg((F.col("confidence") >= 0.3).cast("double")).alias("anomaly"))
    long = A.metric_rows(long, ["y"], ["supervised", "anomaly"])
    return rounded(A.side_by_side(long, "y", "metric", ["supervised", "anomaly"], "value"))


@query("confidence_quantiles", B.with_views(", ".join(["select round(quantile_cont(confidence,0.0),6)+0.0 as q0"] + [
    f"round(quantile_cont(confidence,{q}),6)+0.0 as q{int(q*100)}" for q in (0.25, 0.5, 0.75, 0.95, 1.0)]) + " from scored", "scored"))
def confidence_quantiles(spark, sf):
    """D56."""
    qs = {f"q{int(q * 100)}": q for q in (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)}
    return rounded(exact_quantiles(B.scored(spark, sf), [], "confidence", qs))


@query("upper_quantile", B.with_views("""
select score as threshold from (select score, row_number() over (order by score) as rn, count(*) over () as n from scored where y=0) where rn = ceil(0.95*(n-1))+1""", "scored"))
def upper_quantile(spark, sf):
    """D57."""
    return A.upper_quantile(B.scored(spark, sf).filter("y = 0"), "score", 0.95)


@query("score_buckets", B.with_views(f"select {B.SEVERITY_SQL.format('score')} as severity, score >= 0.5 as is_anomalous, count(*) as n from scored group by all", "scored"))
def score_buckets(spark, sf):
    """B15, B16."""
    from quietwire.functions import numbers as N

    return (B.scored(spark, sf).groupBy(N.severity(F.col("score")).alias("severity"), N.is_anomalous(F.col("score")).alias("is_anomalous"))
            .agg(F.count("*").alias("n")))


@query("confidence_relabel", B.with_views("select case when confidence < 0.3 then 'unknown' else pred end as reported, count(*) as n, round(max(confidence),6)+0.0 as top from multi group by all", "multi"))
def confidence_relabel(spark, sf):
    """B17, B40."""
    from quietwire.functions import numbers as N

    return rounded(B.multi(spark, sf).groupBy(N.relabel_unsure(F.col("pred"), F.col("confidence")).alias("reported"))
                   .agg(F.count("*").alias("n"), F.max("confidence").alias("top")))


@query("fold_spread", B.with_views("""
select count(*) as folds, round(avg(a),6)+0.0 as mean, round(stddev_pop(a),6)+0.0 as std, round(min(a),6)+0.0 as min, round(max(a),6)+0.0 as max
from (select scenario, avg((y=pred)::int) as a from multi group by scenario)""", "multi"))
def fold_spread(spark, sf):
    """D51."""
    per = B.multi(spark, sf).groupBy("scenario").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("a"))
    return rounded(A.spread_of(per, "a"))


V["scen"] = (("multi",), """
select scenario, case when rn <= t then 'train' when rn <= t + (case when t+v >= n then greatest(0,n-t-1) else v end) then 'validation' else 'test' end as split from (
 select scenario, row_number() over (order by md5(scenario||'#42'), scenario) as rn, count(*) over () as n, greatest(1,floor(count(*) over ()*0.7)) as t, floor(count(*) over ()*0.15) as v
 from (select distinct scenario from multi))""")


@query("scenario_split", B.with_views("select split, sum(n)::bigint as rows, count(*) as scenarios, string_agg(scenario, ';' order by scenario) as scenario_list from scen join (select scenario, count(*) as n from multi group by all) using (scenario) group by split", "scen", "multi"))
def scenario_split(spark, sf):
    """L1, L2, L4, C10."""
    m = B.multi(spark, sf)
    return L.provenance(L.assign(m, L.scenario_split(m)))


@query("manifest_coverage", B.with_views("""
select subject, problem from (values ('s6','unassigned'),('s7','unassigned'),('s9','not observed'),('s0','assigned more than once')) t(subject, problem)
where subject='s9' or subject in (select scenario from multi)""", "multi"))
def manifest_coverage(spark, sf):
    """A manifest that forgets two scenarios, names an unknown one and repeats one."""
    m = B.multi(spark, sf)
    names = m.select("scenario").distinct().filter("scenario not in ('s6', 's7')")
    manifest = names.withColumn("split", F.lit("train")).unionByName(
        names.filter("scenario = 's0'").select("scenario", F.explode(F.array(F.lit("test"))).alias("split"))).unionByName(
        names.filter("scenario = 's1'").select(F.lit("s9").alias("scenario"), F.lit("test").alias("split")))
    return L.manifest_problems(m, manifest)


@query("split_overlap", B.with_views("""
select splits, count(*) as identities from (select k, string_agg(distinct split, '+' order by split) as splits, count(distinct split) as c from (
 select (row_id//3)::varchar as k, split from multi join scen using (scenario)) group by k) where c > 1 group by splits""", "multi", "scen"))
def split_overlap(spark, sf):
    """Rows that share an identity across splits."""
    m = B.multi(spark, sf)
    rows = L.assign(m, L.scenario_split(m)).withColumn("identity", F.floor(F.col("row_id") / 3).cast("string"))
    return L.split_overlap(rows, "identity")


@query("temporal_split", B.with_views("""
select split, count(*) as n, min(timestamp) as first_ts, max(timestamp) as last_ts from (select timestamp, case when rn <= floor(n*0.7) then 'train' when rn <= floor(n*0.7)+floor(n*0.15) then 'validation' else 'test' end as split
 from (select timestamp, row_number() over (order by timestamp, event_id) as rn, count(*) over () as n from evts)) group by split""", "evts"))
def temporal_split(spark, sf):
    """L3."""
    rows = L.temporal_split(B.events(spark, sf), "timestamp", "event_id", 86400.0)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("uniform_sample", B.with_views("select row_id from multi order by md5(row_id||'#42'), row_id limit 100", "multi"))
def uniform_sample(spark, sf):
    """L7."""
    return L.uniform_sample(B.multi(spark, sf), "row_id", 100).select("row_id")


@query("stratified_sample", B.with_views("select y, row_id from (select *, row_number() over (partition by y order by md5(row_id||'#42'), row_id) as rn from multi) where rn <= 5", "multi"))
def stratified_sample(spark, sf):
    """F10."""
    return L.stratified_sample(B.multi(spark, sf), "y", "row_id", 5).select("y", "row_id")


V["folds"] = (("fam",), """
select family, scenario, case when is_test then 'test' when rn <= greatest(1, round_even(c*0.15,0)) then 'validation' else 'train' end as split from (
 select *, row_number() over (partition by family, is_test order by md5(scenario||'#42'), scenario) as rn, count(*) over (partition by family, is_test) as c from (
  select f.family, s.scenario, exists (select 1 from fam x where x.y=f.family and x.scenario=s.scenario) as is_test
  from (select y as family from fam where y<>'c0' group by y having count(*) >= 20) f, (select distinct scenario from fam) s))""")


@query("family_folds", B.with_views("""
select family, split, count(*) as rows, round(avg((y<>'c0')::int),6)+0.0 as prevalence, count(*) filter (y=family) as family_rows
from fam join folds using (scenario) group by all""", "fam", "folds"))
def family_folds(spark, sf):
    """K20, G5."""
    rows = family_rows(spark, sf)
    return rounded(L.fold_counts(rows, L.family_folds(rows, benign=BENIGN, minimum=20), benign=BENIGN))


@query("known_families", B.with_views("select distinct y from multi where y<>'c0'", "multi"))
def known_families(spark, sf):
    """G5."""
    return L.families(B.multi(spark, sf), "y", BENIGN)


@query("order_parts_concat", "select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice),2)+0.0 as total from orders group by all")
def order_parts_concat(spark, sf):
    """G1: parts of a table put together again by column name."""
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    parts = [o.filter(F.col("o_orderkey") % 3 == i).select(*cols) for i, cols in enumerate((
        ["o_orderkey", "o_orderpriority", "o_totalprice"], ["o_totalprice", "o_orderkey", "o_orderpriority"],
        ["o_orderpriority", "o_totalprice", "o_orderkey"]))]
    return L.concat(parts).groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
