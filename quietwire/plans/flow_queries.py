"""Queries over packets and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import keys as K
from quietwire.operators import clock
from quietwire.operators.flows import SEGMENT, flow_packets, flows, gap_sessions, inter_arrivals
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded

FLOW_COLUMNS = (
    "flow_id direction_key first_seq last_seq src_ip dst_ip src_port dst_port protocol start_time end_time "
    "duration_sec packet_count byte_count payload_byte_count forward_packet_count reverse_packet_count "
    "forward_bytes reverse_bytes forward_payload_bytes reverse_payload_bytes syn_count syn_ack_count ack_count "
    "fin_count rst_count psh_count direction is_complete").split()


def _rounded_sql(columns, doubles, view):
    cols = ", ".join(f"round({c},6)+0.0 as {c}" if c in doubles else c for c in columns)
    return B.with_views(f"select {cols} from {view}", view)


@query("packet_scan", B.with_views("select * from packets", "packets"))
def packet_scan(spark, sf):
    """A1: packets in arrival order with the fixed schema."""
    return B.packets(spark, sf).select(*[f.name for f in S.PACKET.fields])


@query("conversation_keys", B.with_views("""
select pkt_seq, direction_key, src_ip||':'||coalesce(src_port::varchar,'None')||'-'||dst_ip||':'||coalesce(dst_port::varchar,'None')
  ||'-'||protocol as unidirectional_key from keyed""", "keyed"))
def conversation_keys(spark, sf):
    """B1, B2."""
    return B.packets(spark, sf).select(
        "pkt_seq", K.direction_key().alias("direction_key"),
        K.unidirectional_key().alias("unidirectional_key"))


@query("forward_packets_marked", B.with_views("""
select pkt_seq, direction_key, fwd as is_forward from flowed""", "flowed"))
def forward_packets_marked(spark, sf):
    """Orientation of every packet against the first packet of its flow.

    The first packet is found by an aggregation (combined before the shuffle)
    and joined back, so no flow is sorted as a whole.
    """
    rows = flow_packets(B.packets(spark, sf), B.FLOW_PARAMS, in_order=True)
    first = rows.groupBy(*SEGMENT).agg(F.min_by("lo_to_hi", "pkt_seq").alias("first_lo"))
    return rows.join(first.hint("merge"), SEGMENT).select(
        "pkt_seq", "direction_key", (F.col("lo_to_hi") == F.col("first_lo")).alias("is_forward"))


@query("tcp_flag_marks", B.with_views("""
select pkt_seq, (fl&2)<>0 and (fl&16)=0 as syn, (fl&2)<>0 and (fl&16)<>0 as syn_ack, (fl&16)<>0 as ack,
  (fl&1)<>0 as fin, (fl&4)<>0 as rst, (fl&8)<>0 as psh from keyed""", "keyed"))
def tcp_flag_marks(spark, sf):
    """B4."""
    return B.packets(spark, sf).select("pkt_seq", *[c.alias(n) for n, c in K.flag_marks().items()])


@query("protocol_traffic", B.with_views("""
select case protocol when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP' when 58 then 'ICMPv6' else 'PROTO_'||protocol end as protocol_name,
  case when contains(src_ip,':') then 6.0::double else 4.0::double end as ip_version, count(*) as packets,
  cast(sum(ip_total_length) as bigint) as bytes from packets group by all""", "packets"))
def protocol_traffic(spark, sf):
    """Traffic by protocol name and IP version."""
    return (B.packets(spark, sf)
            .groupBy(K.protocol_name().alias("protocol_name"), K.ip_version("src_ip").alias("ip_version"))
            .agg(F.count("*").alias("packets"), F.sum("ip_total_length").alias("bytes")))


@query("port_families", B.with_views("""
select case when src_port=53 or dst_port=53 then 'decode' when src_port=853 or dst_port=853 then 'ENCRYPTED_OR_UNAVAILABLE'
  else 'none' end as dns_family,
  coalesce(case when protocol=6 and (src_port in (443,8443,853) or dst_port in (443,8443,853)) then 'tls'
  when protocol=17 and (src_port in (443,4433,853) or dst_port in (443,4433,853)) then 'quic' end,'none') as encrypted_family,
  count(*) as packets from packets group by all""", "packets"))
def port_families(spark, sf):
    """Packets by what a DNS, TLS or QUIC reader would do with them."""
    return (B.packets(spark, sf)
            .groupBy(K.dns_candidate().alias("dns_family"),
                     F.coalesce(K.encrypted_family(), F.lit("none")).alias("encrypted_family"))
            .agg(F.count("*").alias("packets")))


@query("flow_segments", B.with_views("""
select direction_key, first_seq, count(*) as packets, max(pkt_seq) as last_seq from flowed group by all""", "flowed"))
def flow_segments(spark, sf):
    """Which packets form a flow, by silence, RST and FIN grace."""
    rows = flow_packets(B.packets(spark, sf), B.FLOW_PARAMS, in_order=True)
    return (rows.groupBy(*SEGMENT)
            .agg(F.min("pkt_seq").alias("first_seq"), F.count("*").alias("packets"),
                 F.max("pkt_seq").alias("last_seq"))
            .select("direction_key", "first_seq", "packets", "last_seq"))


@query("gap_sessions", B.with_views("""
select direction_key, count(*) as packet_count, min(ts) as start_time, max(ts) as end_time from (
  select *, sum(case when lag_ts is null or ts-lag_ts >= 43200 then 1 else 0 end) over (partition by direction_key order by pkt_seq) as seg
  from (select *, lag(ts) over (partition by direction_key order by pkt_seq) as lag_ts from keyed)) group by direction_key, seg""", "keyed"))
def gap_only_sessions(spark, sf):
    """D2."""
    return gap_sessions(B.packets(spark, sf), B.FLOW_PARAMS.idle_sec)


@query("flow_counters", _rounded_sql(FLOW_COLUMNS, {"start_time", "end_time", "duration_sec"}, "flows"))
def flow_counters(spark, sf):
    """D3, D4."""
    return rounded(B.flows(spark, sf).select(*FLOW_COLUMNS))


@query("flow_counters_by_watermark", _rounded_sql(FLOW_COLUMNS, {"start_time", "end_time", "duration_sec"}, "flows"))
def flow_counters_by_watermark(spark, sf):
    """The same flows cut by the arrival watermark, as disordered captures need."""
    return rounded(flows(B.packets(spark, sf), B.FLOW_PARAMS, in_order=False).select(*FLOW_COLUMNS))


@query("flow_directions", B.with_views("""
select direction, is_complete, count(*) as flows, cast(sum(packet_count) as bigint) as packets from flows group by all""", "flows"))
def flow_directions(spark, sf):
    """D4."""
    return (B.flows(spark, sf).groupBy("direction", "is_complete")
            .agg(F.count("*").alias("flows"), F.sum("packet_count").alias("packets")))


@query("inter_arrival_gaps", B.with_views("""
select direction_key, first_seq, fwd, count(*) as n_gaps, round(sum(iat),4)+0.0 as total_gap, round(max(iat),6)+0.0 as max_gap
from gaps group by all""", "gaps"))
def inter_arrival_gaps(spark, sf):
    """D5, E7."""
    rows = flow_packets(B.packets(spark, sf), B.FLOW_PARAMS, in_order=True)
    first = rows.groupBy(*SEGMENT).agg(F.min("pkt_seq").alias("first_seq"),
                                       F.min_by("lo_to_hi", "pkt_seq").alias("first_lo"))
    gaps = (inter_arrivals(rows, B.FLOW_PARAMS, in_order=True).groupBy(*SEGMENT, "lo_to_hi")
            .agg(F.count("*").alias("n_gaps"), F.round(F.sum("iat"), 4).alias("total_gap"),
                 F.round(F.max("iat"), 6).alias("max_gap")))
    return gaps.join(first.hint("merge"), SEGMENT).select(
        "direction_key", "first_seq", (F.col("lo_to_hi") == F.col("first_lo")).alias("fwd"),
        "n_gaps", "total_gap", "max_gap")


@query("flow_features", B.with_views(
    "select flow_id, " + ", ".join(f"round({f},6)+0.0 as {f}" for f in S.FEATURES) + " from features", "features"))
def features_of_flows(spark, sf):
    """The 52 features of every flow."""
    return rounded(B.features(spark, sf).select("flow_id", *S.FEATURES))


@query("arrival_watermark", B.with_views("""
select pkt_seq, round(max(ts) over (order by pkt_seq rows unbounded preceding),6)+0.0 as wm from packets""", "packets"))
def watermark(spark, sf):
    """E4."""
    return rounded(clock.arrival_watermark(B.packets(spark, sf), block_rows=1000).select("pkt_seq", "wm"))


@query("late_packets", B.with_views("""
select protocol, count(*) as packets, count(*) filter (floor(ts/3600) < floor(wm/3600) - 24 + 1) as late
from (select *, max(ts) over (order by jitter rows unbounded preceding) as wm
      from (select *, pkt_seq + case when pkt_seq%10=0 then 500 else 0 end as jitter from packets)) group by all""", "packets"))
def late_packets(spark, sf):
    """E5: every tenth packet is delayed by 500 arrivals, some of them beyond the window."""
    p = B.packets(spark, sf)
    delayed = p.withColumn("pkt_seq", F.col("pkt_seq") + F.when(F.col("pkt_seq") % 10 == 0, 500).otherwise(0))
    rows = clock.late_rows(clock.arrival_watermark(delayed, block_rows=1000),
                           B.WINDOW_PARAMS.window_sec, B.WINDOW_PARAMS.bucket_sec)
    return rows.groupBy("protocol").agg(F.count("*").alias("packets"), F.count_if("is_late").alias("late"))


@query("tick_buckets", B.with_views("""
select floor(ts/3600)::bigint as tick, count(*) as packets, cast(sum(ip_total_length) as bigint) as bytes from packets group by all""", "packets"))
def tick_buckets(spark, sf):
    """E1."""
    return (B.packets(spark, sf).groupBy(clock.tick(F.col("ts"), 3600).alias("tick"))
            .agg(F.count("*").alias("packets"), F.sum("ip_total_length").alias("bytes")))


@query("capture_throughput", B.with_views("""
select (select count(*) from packets) as packets, (select count(*) from flows) as flows,
  round(p/span,6) as packets_per_sec, round(f/span,6) as flows_per_sec, round(b*8/1e6/span,6) as mbps
from (select count(*) as p, sum(ip_total_length) as b, max(ts)-min(ts) as span from packets),
     (select count(*) as f from flows)""", "packets", "flows"))
def capture_throughput(spark, sf):
    """D53."""
    t = B.flows(spark, sf).agg(
        F.sum("packet_count").alias("packets"), F.count("*").alias("flows"), F.sum("byte_count").alias("bytes"),
        (F.max("end_time") - F.min("start_time")).alias("span"))
    return t.select("packets", "flows", F.round(F.col("packets") / F.col("span"), 6).alias("packets_per_sec"),
                    F.round(F.col("flows") / F.col("span"), 6).alias("flows_per_sec"),
                    F.round(F.col("bytes") * 8 / 1e6 / F.col("span"), 6).alias("mbps"))
