"""Queries over TLS hellos and encrypted connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.functions.keys import encrypted_family
from quietwire.operators import encrypted as T
from quietwire.plans import bindings as B
from quietwire.plans.registry import query
from quietwire.schema import EncryptedParams

P = EncryptedParams(ttl_sec=43200.0)

V = B.SQL_VIEWS
V["canon"] = (("hellos",), """
select *, case when handshake_type=2 then b else b||','||g||',0' end as canonical from (
 select *, legacy_version||','||array_to_string(list_filter(ciphers, lambda x: not (x%256=x//256 and x%16=10)),'-')||','||
  array_to_string(list_filter(extensions, lambda x: not (x%256=x//256 and x%16=10)),'-') as b, array_to_string(groups,'-') as g from hellos)""")
V["tlspk"] = (("keyed",), "select * from keyed where protocol=6 and (src_port in (443,8443,853) or dst_port in (443,8443,853))")
V["conn"] = (("tlspk",), """
select *, coalesce(max(case when restart then pkt_seq end) over (partition by direction_key, ep order by pkt_seq), min(pkt_seq) over (partition by direction_key, ep)) as conn_seq from (
 select *, syn is not null and (psyn is null or psyn<>syn) as restart from (
  select *, case when syn is not null then lag(syn) over (partition by direction_key, ep, nc, syn is not null order by pkt_seq) end as psyn from (
   select *, case when (fl&2)<>0 and (fl&16)=0 then lo::varchar end as syn, coalesce(sum(case when (fl&5)<>0 then 1 else 0 end) over (partition by direction_key order by pkt_seq rows between unbounded preceding and 1 preceding),0) as nc,
    sum(case when l is null or ts-l > 43200 then 1 else 0 end) over (partition by direction_key order by pkt_seq) as ep
   from (select *, lag(ts) over (partition by direction_key order by pkt_seq) as l from tlspk))))""")
V["ctime"] = (("conn",), """
select direction_key, conn_seq, count(*) as sample_count, min(ip_total_length) as packet_size_min, max(ip_total_length) as packet_size_max, avg(ip_total_length) as packet_size_mean,
 avg(gap) as gap_mean, max(gap) as gap_max, count(distinct lo) as direction_count from (
 select *, ts - lag(ts) over (partition by direction_key, conn_seq order by ts, pkt_seq) as gap from conn) group by all""")
V["conns"] = (("conn",), "select direction_key, conn_seq, count(*) as packets, min(ts) as started, max(ts) as last from conn group by all")


def tls_packets(spark, sf):
    return B.packets(spark, sf).filter(encrypted_family() == "tls")


def connections(spark, sf):
    return B.stored(spark, sf, "connections", lambda: T.connection_packets(tls_packets(spark, sf), P, in_order=True))


@query("tls_fingerprints", B.with_views("""
select hello_id, case when handshake_type=2 then 'JA3S' else 'JA3' end as family, canonical, md5(canonical) as digest,
 case when handshake_type=2 then coalesce(supported_versions[1], legacy_version) end as selected_version from canon""", "canon"))
def tls_fingerprints(spark, sf):
    """B29, B31, H4."""
    return T.fingerprints(B.hellos(spark, sf)).select("hello_id", "family", "canonical", "digest", "selected_version")


@query("tls_hello_signals", B.with_views("""
select signal_type, count(*) as hellos, round(sum(v),2)+0.0 as total from (
 select case when handshake_type=1 then 'TLS_CLIENT_HELLO_OBSERVED' else 'TLS_SERVER_HELLO_OBSERVED' end as signal_type, 1 as v from hellos
 union all select 'TLS_VERSION_CONTEXT', legacy_version from hellos union all select 'TLS_CIPHER_PROFILE', len(ciphers) from hellos
 union all select 'TLS_EXTENSION_PROFILE', len(extensions) from hellos union all select 'TLS_FINGERPRINT', 1 from hellos) group by all""", "hellos"))
def tls_hello_signals(spark, sf):
    """I22, D60."""
    return T.hello_signals(B.hellos(spark, sf), "hello_id").groupBy("signal_type").agg(
        F.count("*").alias("hellos"), F.round(F.sum("observed_value"), 2).alias("total"))


_STATE = "(['COMPLETE','MALFORMED','TRUNCATED','UNSUPPORTED','INCOMPLETE','OTHER'])[hello_id%6+1]"


@query("tls_connection_status", B.with_views(f"""
select c, coalesce((['COMPLETE','MALFORMED','TRUNCATED','ENCRYPTED_APPLICATION_DATA','UNSUPPORTED','INCOMPLETE'])[min(nullif(list_position(['COMPLETE','MALFORMED','TRUNCATED','ENCRYPTED_APPLICATION_DATA','UNSUPPORTED','INCOMPLETE'], s),0))],'UNAVAILABLE') as tls_status,
 case count(distinct role) filter (s='COMPLETE') when 2 then 'BOTH' when 1 then max(role) filter (s='COMPLETE')||'_ONLY' else 'INCOMPLETE' end as visibility
from (select hello_id//4 as c, {_STATE} as s, case when handshake_type=1 then 'CLIENT' else 'SERVER' end as role from hellos) group by c""", "hellos"))
def tls_connection_status(spark, sf):
    """Neighbouring orders play the directions of one connection."""
    states = F.array(*[F.lit(s) for s in ("COMPLETE", "MALFORMED", "TRUNCATED", "UNSUPPORTED", "INCOMPLETE", "OTHER")])
    rows = B.hellos(spark, sf).select(
        F.floor(F.col("hello_id") / 4).alias("c"), F.element_at(states, (F.col("hello_id") % 6 + 1).cast("int")).alias("status"),
        F.when(F.col("handshake_type") == 1, "CLIENT").otherwise("SERVER").alias("role"))
    return T.tls_status(rows, "c")


@query("hello_kind_counts", B.with_views("select handshake_type, legacy_version, count(*) as hellos from hellos group by all", "hellos"))
def hello_kind_counts(spark, sf):
    """D59."""
    return B.hellos(spark, sf).groupBy("handshake_type", "legacy_version").agg(F.count("*").alias("hellos"))


@query("connection_epochs", B.with_views("select pkt_seq, conn_seq from conn", "conn"))
def connection_epochs(spark, sf):
    """D11."""
    return T.connection_packets(tls_packets(spark, sf), P, in_order=True).select("pkt_seq", "conn_seq")


@query("connection_timing", B.with_views("""
select direction_key, conn_seq, packets, sample_count, packet_size_min, packet_size_max, round(packet_size_mean,6)+0.0 as packet_size_mean, round(gap_mean,4)+0.0 as gap_mean,
 round(gap_max,6)+0.0 as gap_max, direction_count from ctime join conns using (direction_key, conn_seq)""", "ctime", "conns"))
def connection_timing(spark, sf):
    """D10, E6."""
    t = T.connection_timing(connections(spark, sf), P.ttl_sec)
    return t.select("direction_key", "conn_seq", "packets", "sample_count", "packet_size_min", "packet_size_max",
                    F.round("packet_size_mean", 6).alias("packet_size_mean"), F.round("gap_mean", 4).alias("gap_mean"),
                    F.round("gap_max", 6).alias("gap_max"), "direction_count")


@query("connections_in_flows", B.with_views("""
select flow_id, conn_seq, packets from (select f.flow_id, c.conn_seq, c.packets, row_number() over (partition by f.flow_id order by c.last desc, c.conn_seq desc) as rn
 from flows f join conns c on c.direction_key=f.direction_key and c.started>=f.start_time and c.last<=f.end_time) where rn=1""", "flows", "conns"))
def connections_in_flows(spark, sf):
    """C9."""
    t = T.connection_timing(connections(spark, sf), P.ttl_sec)
    return T.contained(B.stored_flows(spark, sf), t, B.FLOW_PARAMS.idle_sec).select("flow_id", "conn_seq", "packets")


@query("session_timing_signals", B.with_views("""
select signal_type, count(*) as connections, sum(sample_count)::bigint as samples from (select 'ENCRYPTED_SESSION_PACKET_TIMING' as signal_type, sample_count from ctime where (direction_key, conn_seq) in
 (select (direction_key, conn_seq) from conn where (fl&2)<>0)) group by all""", "ctime", "conn"))
def session_timing_signals(spark, sf):
    """Connections in which a SYN was seen stand for those with a recognised handshake."""
    rows = connections(spark, sf)
    out = T.timing_signals(T.connection_timing(rows, P.ttl_sec), rows.filter("is_syn or is_syn_ack"), "tls")
    return out.groupBy("signal_type").agg(F.count("*").alias("connections"), F.sum("observed_value").cast("long").alias("samples"))
