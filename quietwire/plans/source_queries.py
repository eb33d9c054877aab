"""Sources, sinks and small reports that the other query modules do not touch."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.operators import detect as D
from quietwire.operators import evaluate as A
from quietwire.operators import events as E
from quietwire.operators import models as M
from quietwire.operators.clock import ranked
from quietwire.plans import bindings as B
from quietwire.plans.evaluation_queries import r
from quietwire.plans.feature_queries import _as_cic
from quietwire.plans.registry import query, rounded
from quietwire.session import shared_folder
from quietwire.sources import datasets
from quietwire.streaming import streams as R


@query("flow_table_folder", B.with_views("""
select case label when 'benign' then 'benign' when 'ddos' then 'ddos' when 'c2' then 'c2' else 'unknown' end as label, count(*) as flows, sum(total_packets) as packets,
 round(avg(syn_ratio),6)+0.0 as syn_ratio, true as named from features group by 1""", "features"))
def flow_table_folder(spark, sf):
    """The flows written as a folder of flow tables and loaded with the file name as scenario."""
    folder = shared_folder(spark, "flow-tables")
    _as_cic(B.stored_features(spark, sf)).drop("flow_id").write.parquet(folder)
    rows = datasets.load_cic(spark, folder)
    return rounded(rows.groupBy("label").agg(
        F.count("*").alias("flows"), F.sum("total_packets").alias("packets"), F.avg("syn_ratio").alias("syn_ratio"),
        F.bool_and(F.col("scenario").startswith("part-") & ~F.col("scenario").endswith(".parquet")).alias("named")))


@query("flow_order", B.with_views("select flow_id, row_number() over (order by start_time, direction_key, first_seq) as place from flows", "flows"))
def flow_order(spark, sf):
    """the place of every flow in the order of completion reports."""
    f = B.stored_flows(spark, sf).withColumn("tie", F.concat_ws("|", "direction_key", F.lpad(F.col("first_seq").cast("string"), 20, "0")))
    return ranked(f, "start_time", "tie", 43200.0).select("flow_id", F.col("rank").alias("place"))


@query("feature_matrix", B.with_views(
    "select flow_id, label, 52 as size, round(" + " + ".join(f"coalesce({c}, 0)" for c in S.FEATURES) + ", 3)+0.0 as total from features", "features"))
def feature_matrix(spark, sf):
    """The feature vector of every flow in schema order, with its label."""
    v = vector_to_array("features")
    rows = M.vectors(B.stored_features(spark, sf), S.FEATURES)
    return rounded(rows.select("flow_id", "label", F.size(v).alias("size"), F.aggregate(v, F.lit(0.0), lambda a, x: a + F.nanvl(x, F.lit(0.0))).alias("total")), 3)


@query("operating_points", B.with_views(f"""
select 'default' as point, 0.5::double as threshold, {r('recall')}, round(fp/(fp+tn),6)+0.0 as fpr from (select *, tp/(tp+fn) as recall from (
 select count(*) filter (score>=0.5 and y=1) as tp, count(*) filter (score>=0.5 and y=0) as fp, count(*) filter (score<0.5 and y=1) as fn, count(*) filter (score<0.5 and y=0) as tn from scored))
union all select 'best f1', threshold, recall, fpr from (select {r('threshold', 'recall', 'fpr')} from sweep order by sweep.f1 desc, sweep.threshold limit 1)
union all select 'fpr 0.01', threshold, recall, actual_fpr from near where target_fpr < 0.03 union all select 'fpr 0.05', threshold, recall, actual_fpr from near where target_fpr > 0.03""".replace(
    "from near", """from (select target_fpr, round(fp/N,6)+0.0 as actual_fpr, round(tp/P,6)+0.0 as recall, round(score,6)+0.0 as threshold from (
 select *, row_number() over (partition by target_fpr order by abs(fp/N-target_fpr), score desc) as rn from curve, (select unnest([0.01::double,0.05::double]) as target_fpr)) where rn=1)"""),
    "scored", "sweep", "curve"))
def operating_points(spark, sf):
    """The default and the best threshold and the points nearest to two false-positive rates, in one report."""
    rows = B.scored(spark, sf)
    return rounded(A.operating_points(rows, [0.01, 0.05]))


@query("merged_explanations", B.with_views("""
select event_id, case when first_seq%3=0 and first_seq%2=0 then '' when first_seq%3=0 then 'b' when first_seq%2=0 then 'a' else 'a,b' end as items,
 not (first_seq%3=0 and first_seq%2=0) as available, case when first_seq%3=0 and first_seq%2=0 then 'no baseline; no model' end as reason from evts""", "evts"))
def merged_explanations(spark, sf):
    """H3: the evidence of two explainers as one."""
    def side(name, missing, why):
        item = F.struct(F.lit(1.0).alias("strength"), F.lit(name).alias("name"))
        return F.struct(F.when(~missing, F.array(item)).alias("items"), (~missing).alias("explanation_available"), F.when(missing, why).alias("unavailable_reason"))

    e = B.events(spark, sf).withColumns({"one": side("a", F.col("first_seq") % 3 == 0, "no baseline"), "two": side("b", F.col("first_seq") % 2 == 0, "no model")})
    m = e.withColumn("m", D.merged_evidence("one", "two"))
    names = F.array_join(F.array_sort(F.transform("m.items", lambda i: i["name"])), ",")
    return m.select("event_id", names.alias("items"), F.col("m.explanation_available").alias("available"), F.col("m.unavailable_reason").alias("reason"))


@query("health_reasons", B.with_views("""
select src_ip, concat_ws(';', case when fragments > 0 then 'empty_payload' end, case when resets > 0 then 'resets' end, case when unknown > 0 then 'unknown_flags' end) as reasons
from (select src_ip, count(*) filter (payload_size < 10) as fragments, count(*) filter ((tcp_flags & 4) <> 0) as resets, count(*) filter (tcp_flags is null and protocol = 6) as unknown
 from packets group by src_ip)""", "packets"))
def health_reasons(spark, sf):
    """What is wrong with a source, by the counters that are not zero."""
    counters = B.packets(spark, sf).groupBy("src_ip").agg(
        F.count_if(F.col("payload_size") < 10).alias("empty_payload"), F.count_if(F.col("tcp_flags").bitwiseAND(4) != 0).alias("resets"),
        F.count_if(F.col("tcp_flags").isNull() & (F.col("protocol") == 6)).alias("unknown_flags"))
    return E.health_reasons(counters, ["empty_payload", "resets", "unknown_flags"]).select("src_ip", F.array_join("reasons", ";").alias("reasons"))


@query("event_feed", "select event_type, count(*) as published, count(*) as stored from events group by all")
def event_feed(spark, sf):
    """Rows are published from what is stored, after it is stored."""
    folder = shared_folder(spark, "feed")
    raw = R.packet_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, "events.parquet")

    def publish(stored, batch_id):
        stored.select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.mode("overwrite").text(f"{folder}/feed/batch_id={batch_id}")

    R.run_to_end(raw, R.store_batches(f"{folder}/out", None, publish), f"{folder}/state")
    fed = spark.read.text(f"{folder}/feed").select(F.get_json_object("value", "$.event_type").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("published"))
    held = spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("stored"))
    return fed.join(held, "event_type")
