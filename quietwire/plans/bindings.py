"""Views of the sample tables as packets, flows, events, DNS messages and scores.

The sample tables hold no packets, so each view derives the fields it needs
from table columns by fixed rules.  ``SQL_VIEWS`` states the same rules for the
SQL side.  The parameters are scaled to the 30 days the events span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.functions.numbers import severity
from quietwire.operators.features import flow_features
from quietwire.operators.flows import flows as build_flows
from quietwire.schema import FlowParams, WindowParams
from quietwire.session import cut_lineage

FLOW_PARAMS = FlowParams(idle_sec=43200.0, fin_grace_sec=3600.0)
WINDOW_PARAMS = WindowParams(
    window_sec=86400, bucket_sec=3600, syn_rate=0.0005, udp_rate=0.0005, udp_flow_rate=0.0001,
    flow_rate=0.0005, packet_rate=0.002, unique_sources=20, entropy_bits=4.0,
    min_entropy_observations=32, min_sessions=6, periodicity_cv=0.6, concentration_ratio=0.25,
    port_fanout=5, host_fanout=5, directional_ratio=1.2, directional_bytes=1000,
    min_directional_flows=2)
EVENT_TYPES = ("benign", "ddos", "c2", "reconnaissance", "dns_tunneling")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(table(spark, sf_dir, "events"))


def packets_of(e: DataFrame) -> DataFrame:
    """Packets from ``events``: one packet per row, ``event_id`` is the arrival number."""
    k = F.get_json_object("props", "$.k").cast("int")
    cli = F.concat(F.lit("10.0.0."), (F.col("user_id") % 25).cast("string"))
    srv = F.concat(F.lit("192.0.2."), (k % 5).cast("string"))
    cp = (F.lit(40000) + F.col("user_id") % 25).cast("int")
    sp = F.element_at(F.array(*[F.lit(p) for p in (443, 80, 53, 8443, 22)]), k % 5 + 1)
    proto = F.when(F.col("user_id") % 5 == 0, 17).otherwise(6)
    back = F.col("event_type") == "view"
    size = F.floor(F.col("value") * 10).cast("int")
    flags = (F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 24)
              .when(F.col("event_type") == "view", 16).when(F.col("event_type") == "purchase", 17)
              .otherwise(4))
    return e.select(
        F.col("event_id").cast("long").alias("pkt_seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"),
        F.when(back, srv).otherwise(cli).alias("src_ip"),
        F.when(back, cli).otherwise(srv).alias("dst_ip"),
        F.when(back, sp).otherwise(cp).alias("src_port"),
        F.when(back, cp).otherwise(sp).alias("dst_port"),
        proto.alias("protocol"), (size + 40).alias("ip_total_length"), size.alias("payload_size"),
        F.when(proto == 6, flags).alias("tcp_flags"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_flows(packets(spark, sf_dir), FLOW_PARAMS, in_order=True)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow features with a scenario and a label, as the evaluation jobs need them."""
    f = flow_features(packets(spark, sf_dir), FLOW_PARAMS, in_order=True)
    return f.withColumns({
        "scenario": F.concat(F.lit("scenario_"), (F.col("first_seq") % 10).cast("string")),
        "label": _pick(F.col("first_seq") % 5),
        "anomaly_score": ((F.col("first_seq") * 37) % 100) / F.lit(100.0),
    })


def _pick(index):
    return F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (index + 1).cast("int"))


def events_of(flow: DataFrame) -> DataFrame:
    """Detection events: one at the end of each flow and, for flows of at least
    three packets, an earlier one at its start."""
    n = F.col("first_seq")
    stages = F.when(F.col("packet_count") >= 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(1)))
    e = flow.withColumn("stage", F.explode(stages))
    score = ((n * 37 + F.col("stage") * 11) % 100) / F.lit(100.0)
    confidence = ((n * 53 + F.col("stage") * 7) % 100) / F.lit(100.0)
    kind = _pick((n + F.col("stage")) % 5)
    live = n % 2 == 0
    return e.select(
        F.concat(F.lit("evt-"), n.cast("string"), F.lit("-"), F.col("stage").cast("string"))
         .alias("event_id"),
        F.when(F.col("stage") == 1, F.col("end_time")).otherwise(F.col("start_time"))
         .alias("timestamp"),
        "flow_id", "first_seq", "stage", score.alias("anomaly_score"),
        severity(score).alias("severity"), kind.alias("threat_type"),
        confidence.alias("confidence"),
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        F.lit("1").alias("model_version"),
        (F.col("end_time") + 5.0).alias("created_at"),
        F.to_json(F.struct(
            F.struct(F.concat(F.lit("m"), (n % 3).cast("string")).alias("model_name"),
                     F.lit("v1").alias("model_version")).alias("deployment_model"),
            F.struct(F.when(live, F.concat(F.lit("eth"), (n % 3).cast("string"))).alias("capture_interface"),
                     F.when(~live, F.concat(F.lit("file"), (n % 4).cast("string"))).alias("replay_file_identifier"),
                     F.when(live, "LIVE").otherwise("REPLAY").alias("source_mode")).alias("source")))
         .alias("metadata"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "events", lambda: events_of(stored_flows(spark, sf_dir)))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the shared checkpoint folder.

    Detections, windows and reports read stored flows and events, as they would
    in production; only the queries about flows and features build them anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build())
    return _STORED[key]


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "flows", lambda: flows(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "features", lambda: features(spark, sf_dir))


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS messages from ``pages``: a query of every page and most of the responses."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("long")
    txid = pid
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    name = F.when(pid % 3 == 0, F.concat(
        F.md5("url"), F.substring(F.md5(pid.cast("string")), 1, 16), F.lit("."), host)).otherwise(host)
    base = p.select(
        (pid * 2).alias("pkt_seq"), (pid * F.lit(2.0)).alias("ts"), txid.alias("transaction_id"),
        F.concat(F.lit("10.0.1."), (txid % 7).cast("string")).alias("client"),
        F.lit("192.0.2.53").alias("server"), (F.lit(42000) + txid % 7).cast("int").alias("client_port"),
        name.alias("qname"), F.when(txid % 4 == 0, 16).otherwise(1).alias("qtype"),
        F.lit(1).alias("qclass"), pid.alias("pid"))
    query = base.select("*", F.lit(False).alias("qr"), F.lit(0).alias("rcode"))
    answer = (base.filter("pid % 5 <> 0")
              .withColumn("ts", F.col("ts") + F.when(F.col("pid") % 7 == 0, 15.0).otherwise(1.0))
              .withColumn("pkt_seq", F.col("pkt_seq") + F.when(F.col("pid") % 7 == 0, 15).otherwise(1))
              .select("*", F.lit(True).alias("qr"),
                      F.when(F.col("transaction_id") % 3 == 0, 3).otherwise(0).alias("rcode")))
    both = query.unionByName(answer)
    return both.select(
        "pkt_seq", "ts",
        F.when(F.col("qr"), F.col("server")).otherwise(F.col("client")).alias("src_ip"),
        F.when(F.col("qr"), F.col("client")).otherwise(F.col("server")).alias("dst_ip"),
        F.when(F.col("qr"), 53).otherwise(F.col("client_port")).alias("src_port"),
        F.when(F.col("qr"), F.col("client_port")).otherwise(53).alias("dst_port"),
        F.lit(17).alias("protocol"), "transaction_id", "qr", "rcode",
        F.array(F.struct(F.col("qname").alias("name"), "qtype", "qclass")).alias("questions"),
        "qname", "qtype", F.lit("PARSED").alias("status"))


def hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TLS hellos from ``lineitem``: one per order, at most seven lines each."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
                    lambda s: s.l_partkey.cast("int")).alias("parts"),
        F.array_sort(F.collect_set(F.col("l_suppkey").cast("int"))).alias("extensions"),
        F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("groups"))
    key = F.col("l_orderkey")
    return g.select(
        key.alias("hello_id"), (F.lit(1) + key % 2).cast("int").alias("handshake_type"),
        (F.lit(769) + key % 3).cast("int").alias("legacy_version"),
        F.when(key % 10 == 0, F.concat(F.array(F.lit(2570)), F.col("parts")))
         .otherwise(F.col("parts")).alias("ciphers"),
        "extensions", "groups",
        F.when(key % 4 == 0, F.array(F.lit(772))).otherwise(F.expr("cast(array() as array<int>)"))
         .alias("supported_versions"),
        F.array(F.lit(0)).alias("point_formats"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truth and anomaly score from ``labels`` and ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.select(
        F.col("doc_id").cast("long").alias("row_id"), F.col("toxic").cast("int").alias("y"),
        F.col("source").alias("scenario"),
        (((F.col("doc_id").cast("long") * 7919) % 1000) / F.lit(1000.0)).alias("score"),
        (((F.col("doc_id").cast("long") * 104729) % 1000) / F.lit(1000.0)).alias("confidence"),
        _pick(F.col("doc_id").cast("long") % 5).alias("pred"))


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class truth and prediction from ``embeddings``: the place of the largest entry, modulo ten classes."""
    e = table(spark, sf_dir, "embeddings")
    best = F.array_max("embedding")
    return e.select(
        F.col("vec_id").cast("long").alias("row_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("y"),
        F.concat(F.lit("c"), ((F.array_position("embedding", best) - 1) % 10).cast("string")).alias("pred"),
        best.cast("double").alias("confidence"),
        F.concat(F.lit("s"), (F.col("vec_id") % 8).cast("string")).alias("scenario"))


# --------------------------------------------------------------------------
# The same views as SQL.  Each entry lists the views it needs first.
# --------------------------------------------------------------------------
_PICK = "(['benign','ddos','c2','reconnaissance','dns_tunneling'])"
SEVERITY_SQL = ("case when {0} >= 0.9 then 'critical' when {0} >= 0.7 then 'high' "
                "when {0} >= 0.5 then 'medium' when {0} >= 0.3 then 'low' else 'info' end")

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "packets": ((), """
select cast(event_id as bigint) as pkt_seq, epoch_us(ts)/1e6 as ts,
  case when event_type='view' then srv else cli end as src_ip,
  case when event_type='view' then cli else srv end as dst_ip,
  cast(case when event_type='view' then sp else cp end as int) as src_port,
  cast(case when event_type='view' then cp else sp end as int) as dst_port,
  proto as protocol, cast(floor(value*10) as int)+40 as ip_total_length,
  cast(floor(value*10) as int) as payload_size,
  case when proto=6 then case event_type when 'signup' then 2 when 'click' then 24
       when 'view' then 16 when 'purchase' then 17 else 4 end end as tcp_flags
from (select *, '10.0.0.'||(user_id%25) as cli, '192.0.2.'||(k%5) as srv, 40000+user_id%25 as cp,
             ([443,80,53,8443,22])[k%5+1] as sp, case when user_id%5=0 then 17 else 6 end as proto
      from (select *, cast(json_extract_string(props,'$.k') as int) as k from events))"""),
    "keyed": (("packets",), """
select *, case when src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) then true else false end as lo,
  case when src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port)
       then src_ip||':'||src_port||'-'||dst_ip||':'||dst_port||'-'||protocol
       else dst_ip||':'||dst_port||'-'||src_ip||':'||src_port||'-'||protocol end as direction_key,
  coalesce(tcp_flags,0) as fl from packets"""),
    "coarse": (("keyed",), """
select *, sum(case when lag_ts is null or ts-lag_ts >= 43200 or (lag_fl & 4) <> 0 then 1 else 0 end)
    over (partition by direction_key order by pkt_seq) as coarse
from (select *, lag(ts) over w as lag_ts, lag(fl) over w as lag_fl from keyed
      window w as (partition by direction_key order by pkt_seq))"""),
    "fins": (("coarse",), """
select direction_key, coarse, pkt_seq, ts from coarse where (fl & 1) <> 0 and (fl & 4) = 0"""),
    "fin_next": (("fins",), """
select a.direction_key, a.coarse, a.pkt_seq, a.ts, min(b.pkt_seq) as succ
from fins a left join fins b on a.direction_key=b.direction_key and a.coarse=b.coarse
  and b.pkt_seq > a.pkt_seq and b.ts >= a.ts + 3600 group by all"""),
    "kept": (("fin_next",), """
select n.* from fin_next n join (select direction_key, coarse, min(pkt_seq) as pkt_seq from fins group by all) f
  using (direction_key, coarse, pkt_seq)
union all
select n.* from kept k join fin_next n on n.direction_key=k.direction_key and n.coarse=k.coarse and n.pkt_seq=k.succ"""),
    "segmented": (("coarse", "kept"), """
select c.*, (select count(*) from kept k where k.direction_key=c.direction_key and k.coarse=c.coarse
             and k.pkt_seq < c.pkt_seq and k.ts + 3600 <= c.ts) as fin_no from coarse c"""),
    "flowed": (("segmented",), """
select *, min(pkt_seq) over f as first_seq,
  first_value(lo) over (partition by direction_key, coarse, fin_no order by pkt_seq) = lo as fwd
from segmented window f as (partition by direction_key, coarse, fin_no)"""),
    "flows": (("flowed",), """
select sha256(direction_key||'#'||first_seq) as flow_id, direction_key, first_seq, max(pkt_seq) as last_seq,
  arg_min(src_ip,pkt_seq) as src_ip, arg_min(dst_ip,pkt_seq) as dst_ip,
  arg_min(src_port,pkt_seq) as src_port, arg_min(dst_port,pkt_seq) as dst_port,
  min(protocol) as protocol, min(ts) as start_time, max(ts) as end_time, max(ts)-min(ts) as duration_sec,
  count(*) as packet_count, cast(sum(ip_total_length) as bigint) as byte_count,
  cast(sum(payload_size) as bigint) as payload_byte_count,
  count(*) filter (fwd) as forward_packet_count, count(*) filter (not fwd) as reverse_packet_count,
  cast(coalesce(sum(ip_total_length) filter (fwd),0) as bigint) as forward_bytes,
  cast(coalesce(sum(ip_total_length) filter (not fwd),0) as bigint) as reverse_bytes,
  cast(coalesce(sum(payload_size) filter (fwd),0) as bigint) as forward_payload_bytes,
  cast(coalesce(sum(payload_size) filter (not fwd),0) as bigint) as reverse_payload_bytes,
  count(*) filter ((fl&2)<>0 and (fl&16)=0) as syn_count, count(*) filter ((fl&2)<>0 and (fl&16)<>0) as syn_ack_count,
  count(*) filter ((fl&16)<>0) as ack_count, count(*) filter ((fl&1)<>0) as fin_count,
  count(*) filter ((fl&4)<>0) as rst_count, count(*) filter ((fl&8)<>0) as psh_count,
  case when count(*) filter (not fwd)=0 then 'forward' when count(*) filter (fwd)=0 then 'reverse'
       else 'bidirectional' end as direction,
  (count(*) filter ((fl&1)<>0) > 0 or count(*) filter ((fl&4)<>0) > 0) as is_complete
from flowed group by direction_key, first_seq"""),
    "gaps": (("flowed",), """
select direction_key, first_seq, fwd, ts - lag_t as iat from (select *, lag(ts) over
  (partition by direction_key, first_seq, fwd order by ts, pkt_seq) as lag_t from flowed)
where lag_t is not null"""),
    "size_stats": (("flowed",), """
select direction_key, first_seq, avg(ip_total_length) as pkt_size_mean, stddev_pop(ip_total_length) as pkt_size_std,
  cast(min(ip_total_length) as double) as pkt_size_min, cast(max(ip_total_length) as double) as pkt_size_max,
  quantile_cont(ip_total_length::double,0.5) as pkt_size_median, quantile_cont(ip_total_length::double,0.25) as pkt_size_p25,
  quantile_cont(ip_total_length::double,0.75) as pkt_size_p75, quantile_cont(ip_total_length::double,0.9) as pkt_size_p90
from flowed group by all"""),
    "gap_stats": (("gaps",), """
select direction_key, first_seq, avg(iat) as iat_mean, stddev_pop(iat) as iat_std, min(iat) as iat_min, max(iat) as iat_max,
  quantile_cont(iat,0.5) as iat_median,
  avg(iat) filter (fwd) as fwd_iat_mean, stddev_pop(iat) filter (fwd) as fwd_iat_std,
  min(iat) filter (fwd) as fwd_iat_min, max(iat) filter (fwd) as fwd_iat_max,
  avg(iat) filter (not fwd) as rev_iat_mean, stddev_pop(iat) filter (not fwd) as rev_iat_std,
  min(iat) filter (not fwd) as rev_iat_min, max(iat) filter (not fwd) as rev_iat_max
from gaps group by all"""),
    "features": (("flows", "size_stats", "gap_stats"), """
select f.flow_id, f.direction_key, f.first_seq, f.src_ip, f.dst_ip, f.start_time, f.end_time, f.packet_count,
  duration_sec, packet_count::double as total_packets, byte_count::double as total_bytes,
  case when duration_sec=0 then 0.0 else packet_count/duration_sec end as packets_per_sec,
  case when duration_sec=0 then 0.0 else byte_count/duration_sec end as bytes_per_sec,
  forward_packet_count::double as forward_packets, reverse_packet_count::double as reverse_packets,
  forward_bytes::double as forward_bytes, reverse_bytes::double as reverse_bytes,
  case when reverse_packet_count=0 then 0.0 else forward_packet_count/reverse_packet_count end as fwd_rev_packet_ratio,
  case when reverse_bytes=0 then 0.0 else forward_bytes/reverse_bytes end as fwd_rev_byte_ratio,
  pkt_size_mean, pkt_size_std, pkt_size_min, pkt_size_max, pkt_size_median, pkt_size_p25, pkt_size_p75, pkt_size_p90,
  coalesce(iat_mean,0) as iat_mean, coalesce(iat_std,0) as iat_std, coalesce(iat_min,0) as iat_min,
  coalesce(iat_max,0) as iat_max, coalesce(iat_median,0) as iat_median,
  coalesce(fwd_iat_mean,0) as fwd_iat_mean, coalesce(fwd_iat_std,0) as fwd_iat_std,
  coalesce(fwd_iat_min,0) as fwd_iat_min, coalesce(fwd_iat_max,0) as fwd_iat_max,
  coalesce(rev_iat_mean,0) as rev_iat_mean, coalesce(rev_iat_std,0) as rev_iat_std,
  coalesce(rev_iat_min,0) as rev_iat_min, coalesce(rev_iat_max,0) as rev_iat_max,
  syn_count::double as syn_count, syn_ack_count::double as syn_ack_count, ack_count::double as ack_count,
  fin_count::double as fin_count, rst_count::double as rst_count, psh_count::double as psh_count,
  syn_count/packet_count as syn_ratio, ack_count/packet_count as ack_ratio, fin_count/packet_count as fin_ratio,
  rst_count/packet_count as rst_ratio, psh_count/packet_count as psh_ratio,
  protocol::double as protocol, case when contains(src_ip,':') then 6.0::double else 4.0::double end as ip_version,
  (protocol=6)::int::double as is_tcp, (protocol=17)::int::double as is_udp, (protocol in (1,58))::int::double as is_icmp,
  payload_byte_count::double as payload_bytes_total, forward_payload_bytes::double as forward_payload_bytes,
  reverse_payload_bytes::double as reverse_payload_bytes,
  case when byte_count=0 then 0.0 else payload_byte_count/byte_count end as payload_ratio,
  'scenario_'||(f.first_seq%10) as scenario, """ + _PICK + """[f.first_seq%5+1] as label,
  ((f.first_seq*37)%100)/100.0::double as anomaly_score
from flows f join size_stats using (direction_key, first_seq) left join gap_stats using (direction_key, first_seq)"""),
    "evts": (("flows",), """
select 'evt-'||first_seq||'-'||stage as event_id, case when stage=1 then end_time else start_time end as timestamp,
  flow_id, first_seq, stage, ((first_seq*37+stage*11)%100)/100.0::double as anomaly_score,
  """ + SEVERITY_SQL.format("((first_seq*37+stage*11)%100)/100.0::double") + """ as severity,
  """ + _PICK + """[(first_seq+stage)%5+1] as threat_type, ((first_seq*53+stage*7)%100)/100.0::double as confidence,
  src_ip, dst_ip, src_port, dst_port, protocol, '1' as model_version, end_time + 5.0::double as created_at,
  'm'||(first_seq%3) as model_name, case when first_seq%2=0 then 'LIVE' else 'REPLAY' end as source_mode,
  case when first_seq%2=0 then 'eth'||(first_seq%3) end as capture_interface,
  case when first_seq%2<>0 then 'file'||(first_seq%4) end as replay_file_identifier
from (select *, unnest(case when packet_count>=3 then [0,1] else [1] end) as stage from flows)"""),
    "dns_base": ((), """
select page_id::bigint as pid, page_id::bigint as transaction_id, '10.0.1.'||(page_id%7) as client,
  '192.0.2.53' as server, (42000+page_id%7)::int as client_port,
  case when page_id%3=0 then md5(url)||substr(md5(page_id::varchar),1,16)||'.' else '' end
    || lower(regexp_extract(url,'^[a-zA-Z]+://([^/:?#]+)',1)) as qname,
  case when page_id%4=0 then 16 else 1 end as qtype, 1 as qclass from pages"""),
    "dns": (("dns_base",), """
select pid*2 as pkt_seq, pid*2.0::double as ts, client as src_ip, server as dst_ip, client_port as src_port, 53 as dst_port,
  17 as protocol, transaction_id, false as qr, 0 as rcode, qname, qtype, qclass, client, server, client_port from dns_base
union all
select pid*2 + case when pid%7=0 then 15 else 1 end, pid*2.0::double + case when pid%7=0 then 15 else 1 end,
  server, client, 53, client_port, 17, transaction_id, true,
  case when transaction_id%3=0 then 3 else 0 end, qname, qtype, qclass, client, server, client_port
from dns_base where pid%5<>0"""),
    "hellos": ((), """
select l_orderkey as hello_id, (1+l_orderkey%2)::int as handshake_type, (769+l_orderkey%3)::int as legacy_version,
  case when l_orderkey%10=0 then list_concat([2570::bigint], list(l_partkey order by l_linenumber, l_partkey))
       else list(l_partkey order by l_linenumber, l_partkey) end as ciphers,
  list_sort(list(distinct l_suppkey)) as extensions, list(l_linenumber order by l_linenumber) as groups,
  case when l_orderkey%4=0 then [772] else []::int[] end as supported_versions
from lineitem group by l_orderkey"""),
    "scored": ((), """
select doc_id::bigint as row_id, toxic::int as y, source as scenario, ((doc_id::bigint*7919)%1000)/1000.0::double as score,
  ((doc_id::bigint*104729)%1000)/1000.0::double as confidence, """ + _PICK + """[doc_id::bigint%5+1] as pred
from labels join documents using (doc_id)"""),
    "multi": ((), """
select vec_id::bigint as row_id, 'c'||label as y, 'c'||((list_position(embedding, list_max(embedding))-1)%10) as pred,
  list_max(embedding)::double as confidence, 's'||(vec_id%8) as scenario from embeddings"""),
}


def with_views(body: str, *views: str) -> str:
    """``body`` preceded by the named views and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL_VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    parts = ",\n".join(f"{v} as {'' if v == 'kept' else 'materialized '}({SQL_VIEWS[v][1]})" for v in order)
    return f"with recursive {parts}\n{body}"
