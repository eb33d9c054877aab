"""Queries over stored flows, detection events and investigations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import numbers as N
from quietwire.functions import text as X
from quietwire.operators import documents as D
from quietwire.operators import events as E
from quietwire.operators import investigate as V
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded
from quietwire.plans.window_queries import behaviour

HORIZON = 86400.0
_REC = "event_id, timestamp, flow_id, severity, threat_type, anomaly_score, confidence"
_TECH = "(values " + ",".join(
    "(" + ",".join("'" + v.replace("'", "''") + "'" for v in (t[0], t[1], t[2], t[3])) + ")" for t in S.TECHNIQUES
) + ") t(threat_type, technique_id, technique_name, tactic)"


def techniques(spark):
    return spark.createDataFrame(list(S.TECHNIQUES), S.TECHNIQUE_SCHEMA)


@query("event_records", B.with_views(f"""
select {_REC}, event_id as id, threat_type as threat_class, model_name, 'v1' as deployment_model_version, source_mode, capture_interface,
 replay_file_identifier, 'not_recorded' as dns_status, 'not_recorded' as tls_status, 'not_recorded' as quic_status from evts""", "evts"))
def event_records(spark, sf):
    """A16, H6, H8."""
    return E.event_records(B.events(spark, sf)).select(
        *_REC.split(", "), "id", "threat_class", "model_name", "deployment_model_version", "source_mode",
        "capture_interface", "replay_file_identifier", "dns_status", "tls_status", "quic_status")


@query("event_assembly", B.with_views("""
select event_id, case when anomaly_score >= 0.5 then 'anomaly_detector' else '' end ||
  case when anomaly_score >= 0.5 and threat_type <> 'benign' then ';' else '' end ||
  case when threat_type <> 'benign' then 'classifier' else '' end as detection_source,
 case when confidence < 0.3 then 'unknown' else threat_type end as reported_type, anomaly_score >= 0.5 as is_anomalous from evts""", "evts"))
def event_assembly(spark, sf):
    """A17, G6, B16, B17."""
    anomalous = N.is_anomalous(F.col("anomaly_score"))
    source = E.detection_source((anomalous, "anomaly_detector"), (F.col("threat_type") != "benign", "classifier"),
                                (anomalous, "anomaly_detector"))
    return B.events(spark, sf).select(
        "event_id", F.array_join(source, ";").alias("detection_source"),
        N.relabel_unsure(F.col("threat_type"), F.col("confidence")).alias("reported_type"),
        anomalous.alias("is_anomalous"))


@query("event_validity", B.with_views("""
select reason as reject_reason, reason is null as is_valid, count(*) as events from (
 select case when first_seq%17=0 or first_seq%19=0 or first_seq%23=0 then 'identity' when first_seq%11=0 then 'endpoint' end as reason from evts) group by all""", "evts"))
def event_validity(spark, sf):
    """Rows with a spoiled id or port are set aside with a reason."""
    spoiled = B.events(spark, sf).withColumns({
        "event_id": F.when(F.col("first_seq") % 17 == 0, F.concat(F.lit("bad id "), F.col("event_id")))
                     .when(F.col("first_seq") % 19 == 0, F.concat(F.lit("-"), F.col("event_id")))
                     .when(F.col("first_seq") % 23 == 0, F.concat(F.col("event_id"), F.lit(".1")))
                     .otherwise(F.col("event_id")),
        "src_port": F.when(F.col("first_seq") % 11 == 0, 70000).otherwise(F.col("src_port"))})
    return E.validity(spoiled).groupBy("reject_reason", "is_valid").agg(F.count("*").alias("events"))


@query("events_with_flow", B.with_views("""
select e.event_id, f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol from evts e left join flows f using (flow_id)""", "evts"))
def events_with_flow(spark, sf):
    """C1."""
    return E.with_flow(B.events(spark, sf), B.stored_flows(spark, sf)).select(
        "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")


@query("event_page", B.with_views("""
select event_id, timestamp, severity, threat_type, src_ip, dst_ip from evts where threat_type='ddos' and severity='high'
 order by timestamp desc, event_id limit 50 offset 10""", "evts"))
def event_page(spark, sf):
    """F2, D22."""
    return E.list_events(B.events(spark, sf), B.stored_flows(spark, sf), 50, 10, threat_type="ddos", severity="high").select(
        "event_id", "timestamp", "severity", "threat_type", "src_ip", "dst_ip")


@query("flow_page", B.with_views("""
select flow_id, start_time, packet_count, direction from flows where start_time >= 1704200000 order by start_time desc, flow_id limit 50 offset 5""", "flows"))
def flow_page(spark, sf):
    """F1."""
    return E.list_flows(B.stored_flows(spark, sf), 50, 5, since=1704200000.0).select(
        "flow_id", "start_time", "packet_count", "direction")


@query("event_by_id", B.with_views("select event_id, flow_id, severity, threat_type from evts where event_id in ('evt-0-1','evt-1-1','evt-5-1')", "evts"))
def event_by_id(spark, sf):
    """F3."""
    return B.events(spark, sf).filter(F.col("event_id").isin("evt-0-1", "evt-1-1", "evt-5-1")).select(
        "event_id", "flow_id", "severity", "threat_type")


@query("filtered_counts", B.with_views("""
select severity, threat_type, count(*) as events from evts where timestamp >= 1704200000 group by all""", "evts"))
def filtered_counts(spark, sf):
    """Counts for every pair of filters at once."""
    return (E.narrowed(B.events(spark, sf), since=1704200000.0).groupBy("severity", "threat_type")
            .agg(F.count("*").alias("events")))


@query("event_stats", B.with_views("""
select threat_type, severity, count(*) as events from evts group by grouping sets ((threat_type),(severity),())""", "evts"))
def event_stats(spark, sf):
    """D21."""
    return E.event_stats(B.events(spark, sf)).select("threat_type", "severity", "events")


@query("severity_bars", B.with_views("""
select severity, n as events, round(n*100.0/max(n) over (),6)+0.0 as percent_of_top from (select severity, count(*) as n from evts group by all)""", "evts"))
def severity_bars(spark, sf):
    """D24."""
    counts = B.events(spark, sf).groupBy("severity").agg(F.count("*").alias("events"))
    return rounded(E.share_of_top(counts, "events"))


@query("orphan_flows", B.with_views("""
select flow_id from flows where flow_id not in (select flow_id from evts where severity in ('high','critical'))""", "flows", "evts"))
def orphan_flows(spark, sf):
    """C4: flows without an event of high severity."""
    serious = B.events(spark, sf).filter(F.col("severity").isin("high", "critical"))
    return E.orphan_flows(B.stored_flows(spark, sf), serious).select("flow_id")


@query("unseen_flows", B.with_views("""
select flow_id, packet_count from flows where first_seq % 3 <> 0""", "flows"))
def unseen_flows(spark, sf):
    """Of a doubled batch only the flows not stored yet, each once."""
    f = B.stored_flows(spark, sf)
    return E.unseen_rows(f.unionByName(f), f.filter("first_seq % 3 = 0"), "flow_id").select("flow_id", "packet_count")


@query("live_feed", B.with_views("select event_id, timestamp from evts order by timestamp desc, event_id limit 100", "evts"))
def live_feed(spark, sf):
    """A12."""
    e = B.events(spark, sf)
    return E.live_feed(e.unionByName(e)).select("event_id", "timestamp")


@query("oldest_events", B.with_views("""
select event_id from (select *, row_number() over (order by timestamp, event_id) as r, count(*) over () as n from evts) where r <= n - 1000""", "evts"))
def oldest_events(spark, sf):
    """F6."""
    return E.oldest_beyond(B.events(spark, sf), 1000).select("event_id")


@query("expired_events", B.with_views("select severity, count(*) as events from evts where timestamp < 1705000000 group by all", "evts"))
def expired_events(spark, sf):
    """F7."""
    return E.older_than(B.events(spark, sf), 1705000000.0).groupBy("severity").agg(F.count("*").alias("events"))


_RETENTION = B.SQL_VIEWS
_RETENTION["victims"] = (("evts",), """
select event_id, flow_id from (select *, row_number() over (order by timestamp, event_id) as r from evts)
where r <= 200 and (r <= greatest((select count(*) from evts) - 500, 0) or timestamp < 1704200000)""")
_RETENTION["gone_flows"] = (("victims", "evts", "flows"), """
select flow_id from flows f where flow_id in (select flow_id from evts) and flow_id not in
 (select flow_id from evts where event_id not in (select event_id from victims)) order by flow_id limit (select 400 - count(*) from victims)""")


@query("retention_batch", B.with_views("""
select 'event' as kind, event_id as id from victims union all select 'flow', flow_id from gone_flows""", "victims", "gone_flows"))
def retention_batch(spark, sf):
    """F8."""
    victims, gone = E.retention_batch(B.events(spark, sf), B.stored_flows(spark, sf), 500, 1704200000.0, 400)
    return victims.select(F.lit("event").alias("kind"), F.col("event_id").alias("id")).unionByName(
        gone.select(F.lit("flow").alias("kind"), F.col("flow_id").alias("id")))


B.SQL_VIEWS["near"] = (("evts",), """
select *, row_number() over (partition by anchor_id order by (anchor_id=other_id) desc, other_ts, other_id) as place,
  count(*) over (partition by anchor_id) > 32 as truncated
from (select a.event_id as anchor_id, a.timestamp as anchor_ts, a.flow_id, b.event_id as other_id, b.timestamp as other_ts
  from evts a join evts b on a.flow_id=b.flow_id and b.timestamp between a.timestamp-86400 and a.timestamp+86400)""")
B.SQL_VIEWS["esig"] = (("sigs", "evts"), """
select event_id, (eval_tick+1)*3600 as window_end, row_number() over (partition by event_id order by signal_type, observed_value) - 1 as number
from sigs join evts using (flow_id)""")
B.SQL_VIEWS["refs"] = (("evts", "esig"), """
select event_id, 'ML classification' as signal_type, 'confidence' as reference from evts
union all select event_id, 'Anomaly score', 'anomaly_score' from evts
union all select event_id, 'BEHAVIORAL evidence', 'behavioral_evidence/'||number from esig""")


def event_signals(spark, sf):
    """Signals numbered inside their event; an event has at most a dozen."""
    place = Window.partitionBy("event_id").orderBy("signal_type", "observed_value")
    e = B.events(spark, sf).select("event_id", "flow_id")
    return behaviour(spark, sf).join(e.hint("merge"), "flow_id").withColumn("number", F.row_number().over(place) - 1)


@query("event_neighbourhoods", B.with_views("select anchor_id, other_id, place, truncated from near where place <= 32", "near"))
def event_neighbourhoods(spark, sf):
    """C2, F11."""
    return E.neighbourhoods(B.events(spark, sf), HORIZON).select("anchor_id", "other_id", "place", "truncated")


@query("busy_neighbourhoods", B.with_views("""
select anchor_id, count(*) as kept, bool_or(truncated) as truncated, string_agg(other_id, ';' order by place) as others from (
 select a.event_id as anchor_id, b.event_id as other_id, row_number() over (partition by a.event_id order by (a.event_id=b.event_id) desc, b.timestamp, b.event_id) as place,
  count(*) over (partition by a.event_id) > 8 as truncated
 from evts a join evts b on a.src_ip=b.src_ip and b.timestamp between a.timestamp-43200 and a.timestamp+43200) where place <= 8 group by all""", "evts"))
def busy_neighbourhoods(spark, sf):
    """C2, F11 with the source as the common key: most anchors have more neighbours than fit."""
    e = B.events(spark, sf).withColumn("flow_id", F.col("src_ip"))
    near = E.neighbourhoods(e, 43200.0, 8)
    listed = F.array_sort(F.collect_list(F.struct("place", "other_id")))
    return near.groupBy("anchor_id").agg(
        F.count("*").alias("kept"), F.bool_or("truncated").alias("truncated"),
        F.array_join(F.transform(listed, lambda x: x.other_id), ";").alias("others"))


@query("evidence_references", B.with_views("select signal_type, reference, count(*) as events from refs group by all", "refs"))
def evidence_references(spark, sf):
    """G3."""
    refs = V.evidence_references(B.events(spark, sf), event_signals(spark, sf))
    return refs.groupBy("signal_type", "reference").agg(F.count("*").alias("events"))


@query("event_timeline", B.with_views("""
select event_id, timestamp, 'event_timestamp_unspecified' as clock, 'recorded_event' as signal_type, 'timestamp' as reference from evts
union all select event_id, created_at, 'processing_time', 'record_created', 'created_at' from evts
union all select event_id, window_end::double, 'capture_event_time', 'behavioral', 'behavioral_evidence/'||number||'/observation_window/end' from esig""", "evts", "esig"))
def event_timeline(spark, sf):
    """G2, F9."""
    return V.timeline(B.events(spark, sf), event_signals(spark, sf)).orderBy("timestamp", "clock", "event_id", "reference")


@query("investigations", B.with_views("""
select anchor_id, sha256('{"anchor":"'||anchor_id||'","events":['||string_agg('"'||other_id||'"', ',' order by other_ts, other_id)||'],"rules":"1.0.0"}') as investigation_id,
 case when max(k) > 1 then 'CORRELATED OBSERVATION' else 'RECORDED OBSERVATION' end as label,
 string_agg(other_id, ';' order by other_ts, other_id) as event_ids, max(kinds) as source_kinds, max(k) as source_count, max(n)::bigint as evidence_count,
 min(other_ts) as first_seen, max(other_ts) as last_seen, bool_or(truncated) as truncated
from near join (select anchor_id, count(distinct signal_type) as k, count(*) as n, string_agg(distinct signal_type, ';' order by signal_type) as kinds
  from near join refs on refs.event_id = near.other_id group by all) using (anchor_id) group by anchor_id""", "near", "refs"))
def investigations(spark, sf):
    """An investigation for every event."""
    return V.investigations(E.event_records(B.events(spark, sf)), event_signals(spark, sf), HORIZON)


@query("investigation_documents", B.with_views("""
select anchor_id, sha256(document) as digest from (
 select anchor_id, '{"anchor_id":"'||anchor_id||'","event_ids":"'||string_agg(other_id, ';' order by other_ts, other_id)||'","evidence_count":'||max(n)::bigint||
  ',"investigation_id":"'||sha256('{"anchor":"'||anchor_id||'","events":['||string_agg('"'||other_id||'"', ',' order by other_ts, other_id)||'],"rules":"1.0.0"}')||
  '","label":"'||case when max(k) > 1 then 'CORRELATED OBSERVATION' else 'RECORDED OBSERVATION' end||'","source_count":'||max(k)||',"source_kinds":"'||max(kinds)||
  '","truncated":'||bool_or(truncated)||'}' as document
 from near join (select anchor_id, count(distinct signal_type) as k, count(*) as n, string_agg(distinct signal_type, ';' order by signal_type) as kinds
  from near join refs on refs.event_id = near.other_id group by all) using (anchor_id) group by anchor_id)""", "near", "refs"))
def investigation_documents(spark, sf):
    """Every investigation as one JSON text, compared by its digest (times are compared in ``investigations``)."""
    found = V.investigations(E.event_records(B.events(spark, sf)), event_signals(spark, sf), HORIZON)
    return V.documents(found.drop("first_seen", "last_seen")).select("anchor_id", "digest")


@query("membership_histogram", B.with_views("""
select events, count(*) as flows from (select flow_id, count(*) as events from evts group by all) group by all""", "evts"))
def membership_histogram(spark, sf):
    """How many flows have how many events."""
    return B.events(spark, sf).groupBy("flow_id").agg(F.count("*").alias("events")).groupBy("events").agg(
        F.count("*").alias("flows"))


@query("technique_rollup", B.with_views(f"""
select technique_id, count(*) as events, min(technique_name) as technique_name, min(tactic) as tactic, max(timestamp) as last_seen
from (select * from evts order by timestamp desc, event_id limit 50) join {_TECH} using (threat_type) group by technique_id""", "evts"))
def technique_rollup(spark, sf):
    """D23."""
    return E.technique_rollup(B.events(spark, sf), techniques(spark))


@query("technique_lookup", B.with_views(f"""
select event_id, technique_id, tactic, case when confidence >= 0.8 then 'likely' when confidence >= 0.5 then 'observed indicators consistent with'
 else 'possible' end as qualification from evts join {_TECH} using (threat_type) where threat_type not in ('benign','unknown','unsupported')""", "evts"))
def technique_lookup(spark, sf):
    """C5, B42."""
    return X.qualified_techniques(B.events(spark, sf), techniques(spark)).select(
        "event_id", "technique_id", "tactic", "qualification")


@query("event_rationale", B.with_views("""
select event_id, 'Anomaly score: '||printf('%.2f',anomaly_score)||' (threshold: 0.5). Classified as '||threat_type||' with confidence '
 ||printf('%.2f',confidence)||'.' as rationale, case threat_type when 'benign' then 'Benign Traffic' when 'ddos' then 'Possible DDoS Attack'
 when 'c2' then 'Possible C2 Beaconing' when 'reconnaissance' then 'Possible Reconnaissance' else 'Possible DNS Tunneling' end as display_name from evts""", "evts"))
def event_rationale(spark, sf):
    """B18, B19."""
    return B.events(spark, sf).select(
        "event_id", X.short_rationale(F.col("anomaly_score"), F.col("threat_type"), F.col("confidence")).alias("rationale"),
        X.threat_display(F.col("threat_type")).alias("display_name"))


@query("flow_display", B.with_views("""
select flow_id, case when d>0 then d||'d ' else '' end || case when d>0 or h>0 then h||'h ' else '' end ||
  case when d>0 or h>0 or m>0 then m||'m ' else '' end || s||'s' as duration_text,
 case when byte_count >= 1024 then printf('%.1f', round(byte_count/1024.0,1))||' KB' else byte_count||' B' end as bytes_text from (
 select flow_id, byte_count, (x//86400) as d, (x%86400)//3600 as h, (x%3600)//60 as m, x%60 as s
 from (select *, floor(duration_sec)::bigint as x from flows))""", "flows"))
def flow_display(spark, sf):
    """B39."""
    return B.stored_flows(spark, sf).select(
        "flow_id", X.duration_text(F.col("duration_sec")).alias("duration_text"),
        X.bytes_text(F.col("byte_count")).alias("bytes_text"))


@query("allowed_metadata", B.with_views("""
select event_id, 'model_name' as name, model_name as value from evts
union all select event_id, 'source_mode', source_mode from evts""", "evts"))
def allowed_metadata(spark, sf):
    """Only allow-listed metadata fields leave the store."""
    fields = F.create_map(
        F.lit("model_name"), F.get_json_object("metadata", "$.deployment_model.model_name"),
        F.lit("source_mode"), F.get_json_object("metadata", "$.source.source_mode"),
        F.lit("model_version"), F.get_json_object("metadata", "$.deployment_model.model_version"))
    return B.events(spark, sf).select("event_id", F.explode(
        X.allowed(fields, "model_name", "source_mode")).alias("name", "value"))


@query("stage_latency", """
select event_type as stage, count(*) as samples, round(quantile_cont(value,0.5),6)+0.0 as p50, round(quantile_cont(value,0.95),6)+0.0 as p95,
 round(quantile_cont(value,0.99),6)+0.0 as p99 from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events)
where r <= 4096 group by all""")
def stage_latency(spark, sf):
    """D52."""
    e = B.table(spark, sf, "events").withColumnRenamed("event_type", "stage")
    return rounded(E.latency_percentiles(e, "stage", "value", "ts", "event_id"))


@query("run_equality", B.with_views("select 0::bigint as only_first, 0::bigint as only_second, count(*) as rows_compared from flows", "flows"))
def run_equality(spark, sf):
    """C14: flows cut by capture order and by watermark are the same rows."""
    columns = ["flow_id", "packet_count", "byte_count", "direction", "fin_count"]
    a = B.stored_flows(spark, sf).select(*columns)
    b = B.build_flows(B.packets(spark, sf), B.FLOW_PARAMS, in_order=False).select(*columns)
    # one pass: each distinct row carries how often either run has it
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    per_row = both.groupBy(*columns).agg(F.sum("side").alias("surplus"), F.count_if(F.col("side") == 1).alias("n"))
    return per_row.agg(F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).alias("only_first"),
                       F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).alias("only_second"),
                       F.sum("n").alias("rows_compared"))


# -- documents with nested parts ---------------------------------------------------
#: What is added to an event's document, by first_seq % 18, and the reason for which it is set aside.
_SPOILED = (
    ('"evidence":{"items":[1]},"dns_evidence":[{"a":1}],"metadata":{"explanation":{"attack_mappings":[]}},"threat_class":null', None),
    ('"event_id":null', "identity"), ('"created_at":5', "time"), ('"created_at":5.5', "source"),
    ('"dns_observation":"x","metadata":{"explanation":{"metadata":{"explanation":1}}}', "observation"), ('"tls_evidence":[1]', "evidence"),
    ('"classification_score":"high"', "number"), ('"capture_interface":7', "text"), ('"evidence":{"items":3}', "model evidence"),
    ('"tls_observation":{"directions":{}}', "directions"), ('"metadata":[]', "metadata"), ('"metadata":{"attack_mappings":{}}', "techniques"),
    ('"event_id":"other"', "conflicting identity"), ('"threat_class":"other"', "conflicting class"), ('"src_port":70000', "endpoint"), ('"src_port":', "document"),
    ('"quic_observation":{"directions":[1,2,3]}', "directions"), ('"dns_observation":{"directions":[]}', "directions"))


def event_documents(spark, sf):
    """Every event as JSON text; seventeen of eighteen break one rule each."""
    n = (F.col("first_seq") % len(_SPOILED)).cast("int")
    base = F.to_json(F.struct(
        F.when(n == 1, "bad id").otherwise(F.col("event_id")).alias("id"), F.when(n != 2, F.col("timestamp")).alias("timestamp"),
        F.when(n == 3, "TAPE").otherwise("LIVE").alias("source_mode"), "threat_type", "flow_id", "dst_port"))
    extra = F.element_at(F.array(*[F.lit(text) for text, _ in _SPOILED]), n + 1)
    return B.events(spark, sf).withColumns({"base": base, "extra": extra}).select(
        "event_id", F.concat(F.expr("substring(base, 1, length(base) - 1)"), F.lit(","), F.col("extra"), F.lit("}")).alias("document"))


@query("event_document_validity", B.with_views(
    "select event_id, ([" + ", ".join("null" if r is None else f"'{r}'" for _, r in _SPOILED) + "])[first_seq % 18 + 1] as reject_reason, first_seq % 18 = 0 as is_valid from evts", "evts"))
def event_document_validity(spark, sf):
    """One document in eighteen is valid, each other kind breaks one rule."""
    return D.document_validity(event_documents(spark, sf)).select("event_id", "reject_reason", "is_valid")


@query("projected_documents", B.with_views("""
select * from (select 'id' as path, 'STRING' as kind, count(*) filter (n not in (4, 15)) as leaves from d union all select 'threat_type', 'STRING', count(*) filter (n not in (4, 15)) from d
 union all select 'evidence.items[0]', 'BIGINT', count(*) filter (n = 0) from d union all select 'evidence.items', 'BIGINT', count(*) filter (n = 8) from d
 union all select '', 'REFUSED', count(*) filter (n = 4) from d) where leaves > 0""".replace("from d", "from (select first_seq % 18 as n from evts)"), "evts"))
def projected_documents(spark, sf):
    """Leaves below allowed names; a document nested too deeply is refused."""
    names = ("id", "threat_type", "evidence", "items", "dns_evidence", "metadata", "explanation")
    found = D.projected_leaves(event_documents(spark, sf), "event_id", names, D.Bounds(depth=3))
    return found.groupBy("path", "kind").agg(F.count("*").alias("leaves"))
