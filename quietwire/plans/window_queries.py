"""Queries over trailing windows and behavioural signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quietwire.operators import signals as G
from quietwire.operators import windows as W
from quietwire.operators.clock import tick
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded

P = B.WINDOW_PARAMS

# the windows of every flow, written as range joins
_VIEWS = {
    "ticks": (("packets",), "select floor(ts/3600)::bigint as tick, max(ts) as top_ts from packets group by all"),
    "fin_of": (("flowed",), "select direction_key, first_seq, min(ts) filter ((fl&1)<>0) as first_fin_ts from flowed group by all"),
    "closing": (("flows", "fin_of", "ticks", "packets"), """
select *, case when rst_count>0 then end_tick else coalesce(
    (select min(floor(p.ts/3600)) from packets p where p.ts >= d.due)::bigint, (select max(tick) from ticks)) end as eval_tick
from (select f.*, floor(end_time/3600)::bigint as end_tick,
        least(end_time+43200, coalesce(first_fin_ts+3600,'infinity'::double)) as due
      from flows f join fin_of using (direction_key, first_seq)) d"""),
    "judged": (("closing",), "select * from closing where end_tick > eval_tick - 24"),
    "dst_pts": (("judged",), "select distinct dst_ip, eval_tick as t from judged"),
    "dst_pk": (("dst_pts", "packets"), """
select d.dst_ip, d.t, src_ip, count(*) as n, count(*) filter (protocol=6 and (tcp_flags&2)<>0 and (tcp_flags&16)=0) as syn,
  count(*) filter (protocol=17) as udp
from dst_pts d join packets p on p.dst_ip=d.dst_ip and floor(p.ts/3600) between d.t-23 and d.t group by all"""),
    "dst_fl": (("dst_pts", "flows"), """
select d.dst_ip, d.t, count(*) as flows, count(*) filter (protocol=17) as udp_flows
from dst_pts d join flows f on f.dst_ip=d.dst_ip and floor(f.start_time/3600) between d.t-23 and d.t group by all"""),
    "dst_win": (("dst_pk", "dst_fl"), """
select p.dst_ip, p.t, p.packets, p.syn, p.udp, coalesce(flows,0) as flows, coalesce(udp_flows,0) as udp_flows, source_distinct, source_entropy
from (select dst_ip, t, sum(n)::bigint as packets, sum(syn)::bigint as syn, sum(udp)::bigint as udp, count(*) as source_distinct,
        -sum(n/tot*log2(n/tot)) as source_entropy from (select *, sum(n) over (partition by dst_ip,t) as tot from dst_pk) group by dst_ip, t) p
left join dst_fl using (dst_ip, t)"""),
    "src_win": (("judged", "flows"), """
select d.src_ip, d.t, count(*) as sessions, count(distinct dst_ip) as host_distinct, count(distinct dst_port) as port_distinct
from (select distinct src_ip, eval_tick as t from judged) d join flows f on f.src_ip=d.src_ip
  and floor(f.start_time/3600) between d.t-23 and d.t group by all"""),
    "con_win": (("judged", "flows"), """
select d.src_ip, d.dst_ip, d.t, count(*) as to_destination
from (select distinct src_ip, dst_ip, eval_tick as t from judged) d join flows f on f.src_ip=d.src_ip and f.dst_ip=d.dst_ip
  and floor(f.start_time/3600) between d.t-23 and d.t group by all"""),
    "pair_pts": (("judged",), "select distinct src_ip, dst_ip, protocol, dst_port, eval_tick as t from judged"),
    "pair_times": (("pair_pts", "flows"), """
select src_ip, dst_ip, protocol, dst_port, t, count(*) as n_times, avg(gap) as gap_mean, stddev_pop(gap) as gap_std
from (select *, start_time - lag(start_time) over (partition by src_ip,dst_ip,protocol,dst_port,t order by start_time) as gap from (
  select d.*, f.start_time
  from pair_pts d join flows f using (src_ip,dst_ip,protocol,dst_port)
  where floor(f.start_time/3600) between d.t-23 and d.t)) group by all"""),
    "pair_bytes": (("pair_pts", "judged"), """
select d.src_ip, d.dst_ip, d.protocol, d.dst_port, d.t, sum(j.forward_bytes)::bigint as fwd_bytes, sum(j.reverse_bytes)::bigint as rev_bytes,
  count(*) filter (greatest(forward_bytes,reverse_bytes)/greatest(least(forward_bytes,reverse_bytes),1) >= 1.2 and forward_bytes>=reverse_bytes) as heavy_forward,
  count(*) filter (greatest(forward_bytes,reverse_bytes)/greatest(least(forward_bytes,reverse_bytes),1) >= 1.2 and forward_bytes<reverse_bytes) as heavy_reverse
from pair_pts d join judged j using (src_ip,dst_ip,protocol,dst_port) where j.eval_tick <= d.t and j.end_tick > d.t-24 group by all"""),
    "wide": (("judged", "dst_win", "src_win", "con_win", "pair_times", "pair_bytes"), """
select j.flow_id, j.first_seq, j.eval_tick, coalesce(w.packets,0) as packets, coalesce(w.syn,0) as syn, coalesce(w.udp,0) as udp,
  coalesce(w.flows,0) as flows, coalesce(w.udp_flows,0) as udp_flows, coalesce(w.source_distinct,0) as source_distinct,
  coalesce(w.source_entropy,0.0) as source_entropy,
  coalesce(s.sessions,0) as sessions, coalesce(s.host_distinct,0) as host_distinct, coalesce(s.port_distinct,0) as port_distinct,
  coalesce(c.to_destination/s.sessions,0.0) as concentration,
  coalesce(t.n_times,0) as n_times, t.gap_mean, t.gap_std, case when gap_mean>0 then gap_std/gap_mean end as gap_cv,
  b.fwd_bytes, b.rev_bytes, b.heavy_forward, b.heavy_reverse
from judged j left join dst_win w on w.dst_ip=j.dst_ip and w.t=j.eval_tick
left join src_win s on s.src_ip=j.src_ip and s.t=j.eval_tick
left join con_win c on c.src_ip=j.src_ip and c.dst_ip=j.dst_ip and c.t=j.eval_tick
left join pair_times t on t.src_ip=j.src_ip and t.dst_ip=j.dst_ip and t.protocol=j.protocol and t.dst_port=j.dst_port and t.t=j.eval_tick
join pair_bytes b on b.src_ip=j.src_ip and b.dst_ip=j.dst_ip and b.protocol=j.protocol and b.dst_port=j.dst_port and b.t=j.eval_tick"""),
    "sigs": (("wide",), """
select flow_id, first_seq, eval_tick, 'SYN_RATE' as signal_type, 'stream_ddos' as detector, syn/86400 as observed_value, 0.0005::double as threshold, '>=' as comparison from wide where syn/86400 >= 0.0005
union all select flow_id, first_seq, eval_tick, 'UDP_RATE','stream_ddos', udp/86400, 0.0005, '>=' from wide where udp/86400 >= 0.0005
union all select flow_id, first_seq, eval_tick, 'UDP_FLOW_RATE','stream_ddos', udp_flows/86400, 0.0001, '>=' from wide where udp_flows/86400 >= 0.0001
union all select flow_id, first_seq, eval_tick, 'FLOW_RATE','stream_ddos', flows/86400, 0.0005, '>=' from wide where flows/86400 >= 0.0005
union all select flow_id, first_seq, eval_tick, 'DESTINATION_PACKET_RATE','stream_ddos', packets/86400, 0.002, '>=' from wide where packets/86400 >= 0.002
union all select flow_id, first_seq, eval_tick, 'UNIQUE_SOURCE_COUNT','stream_ddos', source_distinct, 20, '>=' from wide where source_distinct >= 20
union all select flow_id, first_seq, eval_tick, 'SOURCE_DISTRIBUTION_ENTROPY','stream_ddos', source_entropy, 4.0, '>=' from wide where packets >= 32 and source_entropy >= 4.0
union all select flow_id, first_seq, eval_tick, 'DESTINATION_CONCENTRATION','stream_c2', concentration, 0.25, '>=' from wide where sessions >= 6 and concentration >= 0.25
union all select flow_id, first_seq, eval_tick, 'C2_PERIODICITY_EVIDENCE','stream_c2', gap_cv, 0.6, '<=' from wide where n_times >= 6 and gap_cv <= 0.6 and concentration >= 0.25
union all select flow_id, first_seq, eval_tick, 'PORT_FANOUT','stream_recon', port_distinct, 5, '>=' from wide where port_distinct >= 5
union all select flow_id, first_seq, eval_tick, 'HOST_FANOUT','stream_recon', host_distinct, 5, '>=' from wide where host_distinct >= 5
union all select flow_id, first_seq, eval_tick, 'DIRECTIONAL_ASYMMETRY','stream_asymmetry', fwd_bytes/greatest(rev_bytes,1), 1.2, '>=' from wide
  where fwd_bytes >= 1000 and fwd_bytes/greatest(rev_bytes,1) >= 1.2 and heavy_forward >= 2
union all select flow_id, first_seq, eval_tick, 'DIRECTIONAL_ASYMMETRY','stream_asymmetry', rev_bytes/greatest(fwd_bytes,1), 1.2, '>=' from wide
  where rev_bytes >= 1000 and rev_bytes/greatest(fwd_bytes,1) >= 1.2 and heavy_reverse >= 2"""),
}
B.SQL_VIEWS.update(_VIEWS)


def wide(spark, sf):
    def build():
        return W.flow_windows(B.packets(spark, sf), B.stored_flows(spark, sf), B.FLOW_PARAMS, P)

    return B.stored(spark, sf, "windows", build)


def behaviour(spark, sf):
    return G.behaviour_signals(wide(spark, sf), P)


@query("flow_closing_ticks", B.with_views("""
select flow_id, end_tick, eval_tick, end_tick > eval_tick - 24 as in_window from closing""", "closing"))
def flow_closing_ticks(spark, sf):
    """When each flow is closed on the capture clock."""
    return W.closing_ticks(B.stored_flows(spark, sf), B.packets(spark, sf), B.FLOW_PARAMS, P).select(
        "flow_id", "end_tick", "eval_tick", "in_window")


@query("destination_series", B.with_views("""
select dst_ip, tick, packets, syn, udp, coalesce(flows,0) as flows, coalesce(udp_flows,0) as udp_flows from (
 select dst_ip, floor(ts/3600)::bigint as tick, count(*) as packets, count(*) filter (protocol=6 and (tcp_flags&2)<>0 and (tcp_flags&16)=0) as syn,
  count(*) filter (protocol=17) as udp from packets group by all)
left join (select dst_ip, floor(start_time/3600)::bigint as tick, count(*) as flows, count(*) filter (protocol=17) as udp_flows
  from flows group by all) using (dst_ip, tick)""", "packets", "flows"))
def destination_series(spark, sf):
    """D12."""
    return W.destination_series(B.packets(spark, sf), B.stored_flows(spark, sf), P.bucket_sec)


@query("trailing_destination_totals", B.with_views("""
select a.dst_ip, a.tick, sum(b.packets)::bigint as packets, sum(b.bytes)::bigint as bytes
from (select dst_ip, floor(ts/3600)::bigint as tick from packets group by all) a
join (select dst_ip, floor(ts/3600)::bigint as tick, count(*) as packets, sum(ip_total_length) as bytes from packets group by all) b
  on a.dst_ip=b.dst_ip and b.tick between a.tick-23 and a.tick group by all""", "packets"))
def trailing_destination_totals(spark, sf):
    """Packets and bytes in the window ending at each busy tick."""
    series = (B.packets(spark, sf).groupBy("dst_ip", tick(F.col("ts"), P.bucket_sec).alias("tick"))
              .agg(F.count("*").alias("packets"), F.sum("ip_total_length").alias("bytes")))
    names = ["packets", "bytes"]
    return W.values_at(W.changes(series, ["dst_ip"], names, P.span), series, ["dst_ip"], names)


@query("trailing_distinct_sources", B.with_views("""
select dst_ip, tick, count(*) as unique_sources, round(-sum(n/tot*log2(n/tot)),4)+0.0 as entropy from (
 select *, sum(n) over (partition by dst_ip, tick) as tot from (
  select a.dst_ip, a.tick, p.src_ip, count(*) as n from (select distinct dst_ip, floor(ts/3600)::bigint as tick from packets) a
  join packets p on p.dst_ip=a.dst_ip and floor(p.ts/3600) between a.tick-23 and a.tick group by all)) group by all""", "packets"))
def trailing_distinct_sources(spark, sf):
    """Distinct sources of a destination and their entropy, window by window."""
    p = B.packets(spark, sf)
    counted = (p.groupBy("dst_ip", "src_ip", tick(F.col("ts"), P.bucket_sec).alias("tick"))
               .agg(F.count("*").alias("n")))
    members = W.member_changes(counted, ["dst_ip"], "src_ip", P.span, "source")
    total = W.changes(counted.groupBy("dst_ip", "tick").agg(F.sum("n").alias("n")), ["dst_ip"], ["n"], P.span)
    at = W.values_at(total.unionByName(members, allowMissingColumns=True), counted, ["dst_ip"],
                     ["n", "source_distinct", "source_nlogn"])
    return rounded(at.select("dst_ip", "tick", F.col("source_distinct").alias("unique_sources"),
                             W.entropy_bits(F.col("n"), F.col("source_nlogn")).alias("entropy")), 4)


@query("source_sessions", B.with_views("""
select src_ip, floor(start_time/3600)::bigint as tick, count(*) as sessions, count(distinct dst_ip) as destinations,
  count(distinct dst_port) as ports from flows group by all""", "flows"))
def source_sessions(spark, sf):
    """Sessions, destinations and ports a source opened per tick."""
    return (B.stored_flows(spark, sf).groupBy("src_ip", tick(F.col("start_time"), P.bucket_sec).alias("tick"))
            .agg(F.count("*").alias("sessions"), F.count_distinct("dst_ip").alias("destinations"),
                 F.count_distinct("dst_port").alias("ports")))


@query("destination_frequencies", B.with_views("""
select src_ip, dst_ip, n as sessions, round(n/sum(n) over (partition by src_ip),6)+0.0 as frequency, round(max(n) over (partition by src_ip)/sum(n) over (partition by src_ip),6)+0.0 as concentration
from (select src_ip, dst_ip, count(*) as n from flows group by all)""", "flows"))
def destination_frequencies(spark, sf):
    """How often each source chose each destination, one row for each pair."""
    counted = B.stored_flows(spark, sf).groupBy("src_ip", "dst_ip").agg(F.count("*").alias("sessions"))
    whole = counted.groupBy("src_ip").agg(F.sum("sessions").alias("all"), F.max("sessions").alias("top"))
    return rounded(counted.join(whole, "src_ip").select(
        "src_ip", "dst_ip", "sessions", (F.col("sessions") / F.col("all")).alias("frequency"), (F.col("top") / F.col("all")).alias("concentration")))


@query("session_periodicity", B.with_views("""
select src_ip, dst_ip, protocol, dst_port, count(*)+1 as sessions, round(avg(gap),4)+0.0 as gap_mean, round(stddev_pop(gap)/avg(gap),6)+0.0 as gap_cv
from (select *, start_time - lag(start_time) over (partition by src_ip,dst_ip,protocol,dst_port order by start_time, first_seq) as gap from flows)
where gap is not null group by all having avg(gap) > 0 and count(*)+1 >= 6""", "flows"))
def session_periodicity(spark, sf):
    """Regularity of the sessions of every source, destination, protocol and port.

    Gaps are formed inside one capture day of a pair; the gap between two days
    joins their ends, so no pair is ordered as a whole.
    """
    f = B.stored_flows(spark, sf).withColumn("day", tick(F.col("start_time"), 86400))
    local = Window.partitionBy(*W.PAIR, "day").orderBy("start_time", "first_seq")
    inner = f.withColumn("gap", F.col("start_time") - F.lag("start_time").over(local)).filter("gap is not null")
    ends = f.groupBy(*W.PAIR, "day").agg(F.min("start_time").alias("head"), F.max("start_time").alias("tail"))
    border = ends.withColumn("gap", F.col("head") - F.lag("tail").over(
        Window.partitionBy(*W.PAIR).orderBy("day"))).filter("gap is not null")
    gaps = inner.select(*W.PAIR, "gap").unionByName(border.select(*W.PAIR, "gap"))
    out = gaps.groupBy(*W.PAIR).agg((F.count("*") + 1).alias("sessions"), F.avg("gap").alias("mean"),
                                    F.stddev_pop("gap").alias("std"))
    return out.filter((F.col("mean") > 0) & (F.col("sessions") >= P.min_sessions)).select(
        *W.PAIR, "sessions", F.round("mean", 4).alias("gap_mean"),
        F.round(F.col("std") / F.col("mean"), 6).alias("gap_cv"))


@query("recent_sessions", B.with_views("""
select src_ip, dst_ip, protocol, dst_port, count(*) as kept, min(start_time) as oldest, max(start_time) as newest from (
 select *, row_number() over (partition by src_ip,dst_ip,protocol,dst_port order by start_time desc, first_seq desc) as rn from flows)
where rn <= 8 group by all""", "flows"))
def recent_sessions(spark, sf):
    """The newest eight sessions of every pair; the cut happens before the shuffle."""
    newest = Window.partitionBy(*W.PAIR).orderBy(F.col("start_time").desc(), F.col("first_seq").desc())
    kept = B.stored_flows(spark, sf).withColumn("rank", F.row_number().over(newest)).filter("rank <= 8")
    return kept.groupBy(*W.PAIR).agg(F.count("*").alias("kept"), F.min("start_time").alias("oldest"),
                                     F.max("start_time").alias("newest"))


@query("flow_windows", B.with_views("""
select flow_id, eval_tick, packets, syn, udp, flows, udp_flows, source_distinct, round(source_entropy,4)+0.0 as source_entropy, sessions,
  host_distinct, port_distinct, round(concentration,6)+0.0 as concentration, n_times, round(gap_mean+0.0000137::double,2)+0.0 as gap_mean, round(gap_cv,6)+0.0 as gap_cv,
  fwd_bytes, rev_bytes, heavy_forward, heavy_reverse, (eval_tick-23)*3600 as window_start, (eval_tick+1)*3600 as window_end from wide""", "wide"))
def windows_of_flows(spark, sf):
    """All window values of every flow at its closing tick."""
    return wide(spark, sf).select(
        "flow_id", "eval_tick", "packets", "syn", "udp", "flows", "udp_flows", "source_distinct",
        F.round("source_entropy", 4).alias("source_entropy"), "sessions", "host_distinct", "port_distinct",
        F.round("concentration", 6).alias("concentration"), "n_times",
        # gaps are whole microseconds here and doubles there: two decimals, and none of them decided by a tie
        F.round(F.col("gap_mean") + 0.0000137, 2).alias("gap_mean"), F.round("gap_cv", 6).alias("gap_cv"), "fwd_bytes", "rev_bytes",
        "heavy_forward", "heavy_reverse", "window_start", "window_end")


@query("behaviour_signals", B.with_views("""
select flow_id, signal_type, detector, round(observed_value,4)+0.0 as observed_value, round(threshold,4) as threshold, comparison from sigs""", "sigs"))
def behaviour_signal_rows(spark, sf):
    """I1-I12."""
    return rounded(behaviour(spark, sf).select(
        "flow_id", "signal_type", "detector", "observed_value", "threshold", "comparison"), 4)


@query("signal_counts", B.with_views("""
select detector, signal_type, count(*) as occurrences, count(distinct flow_id) as flows from sigs group by all""", "sigs"))
def signal_counts(spark, sf):
    """D60."""
    return G.signal_counts(behaviour(spark, sf))


@query("signal_policy", B.with_views("""
select action, behavioral_alert, count(*) as flows, sum(n)::bigint as signals from (
 select flow_id, coalesce(n,0) as n, case when n>0 then 'enrich_ml' else 'informational' end as action, false as behavioral_alert
 from flows left join (select flow_id, count(*) as n from sigs group by all) using (flow_id)) group by all""", "sigs", "flows"))
def signal_policy(spark, sf):
    """B41."""
    out = G.policy(behaviour(spark, sf), B.stored_flows(spark, sf), P)
    return out.groupBy("action", "behavioral_alert").agg(F.count("*").alias("flows"), F.sum("signals").alias("signals"))


@query("signal_techniques", B.with_views("""
select flow_id, detector, case detector when 'stream_ddos' then 'T1498' else 'T1046' end as technique_id,
  case detector when 'stream_ddos' then 'Impact' else 'Discovery' end as tactic
from (select distinct flow_id, detector from sigs where detector in ('stream_ddos','stream_recon'))""", "sigs"))
def signal_techniques(spark, sf):
    """I21."""
    return G.technique_context(behaviour(spark, sf)).select("flow_id", "detector", "technique_id", "tactic")
