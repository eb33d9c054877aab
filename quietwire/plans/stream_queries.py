"""The streaming operators run to the end of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.plans import bindings as B
from quietwire.plans.registry import query
from quietwire.session import cut_lineage, shared_folder
from quietwire.streaming import streams as R
from quietwire.streaming.batchlog import BatchLog, store_flows_and_events


def _packets(spark, sf):
    """The packet view as a stream over the events file."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = R.packet_stream(spark, sf, schema, "events.parquet")
    return B.packets_of(raw)


def _collected(spark, stream, mode="append", key=None):
    folder = shared_folder(spark, "stream")
    R.run_to_end(stream, R.store_batches(f"{folder}/out", key), f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out")


@query("stream_bucket_counts", B.with_views("""
select protocol, epoch_us(time_bucket(interval '1 hour', make_timestamp(cast(ts*1e6 as bigint))))//1000000 as bucket_start, count(*) as packets, cast(sum(ip_total_length) as bigint) as bytes
from packets group by all""", "packets"))
def stream_bucket_counts(spark, sf):
    """J1, J4, A6, A10."""
    counts = R.bucket_counts(R.event_time(_packets(spark, sf), "1 hour"), "1 hour", "protocol")
    out = _collected(spark, counts, "complete")
    last = out.agg(F.max("batch_id").alias("batch_id"))  # complete mode: the last batch holds everything
    return out.join(last, "batch_id").select("protocol", F.unix_seconds("bucket_start").alias("bucket_start"), "packets", "bytes")


@query("stream_trailing_counts", B.with_views("""
select protocol, tick, sum(n)::bigint as packets from (select a.protocol, a.tick, b.n from (select protocol, floor(ts/3600)::bigint as tick from packets group by all) a
 join (select protocol, floor(ts/3600)::bigint as tick, count(*) as n from packets group by all) b on a.protocol=b.protocol and b.tick between a.tick-23 and a.tick) group by all""", "packets"))
def stream_trailing_counts(spark, sf):
    """Trailing day from streamed hourly buckets."""
    counts = R.bucket_counts(R.event_time(_packets(spark, sf), "1 hour"), "1 hour", "protocol")
    out = _collected(spark, counts, "complete")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return R.trailing_from_buckets(out.join(last, "batch_id"), 24, 3600, "protocol")


PARTS = 3


def _clocked_log(spark, view, rows):
    """``rows`` (with arrival numbers) sent through a clocked log in three files by arrival."""
    folder = shared_folder(spark, "stream")
    rows = cut_lineage(rows)
    low, high = rows.agg(F.min("pkt_seq"), F.max("pkt_seq")).first()
    width = ((high or 0) - (low or 0)) // PARTS + 1
    for part in range(PARTS):
        inside = rows.filter(F.floor((F.col("pkt_seq") - F.lit(low or 0)) / width) == part)
        inside.write.mode("append").parquet(f"{folder}/in/part={part}")
    log = BatchLog(spark, f"{folder}/{view}")
    for part in range(PARTS):
        raw = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part={part}")
        R.run_to_end(raw, lambda batch, n, part=part: R.clock_batches(log)(batch, part), f"{folder}/clock-{part}")
    R.use_state_store(spark)
    return log, rows.schema, folder


def _stateful(spark, log, schema, folder, operator):
    """The results of a stateful operator over the log, stored, and its checkpoint."""
    stream = operator(R.clocked_stream(log, schema))
    R.run_to_end(stream, R.store_batches(f"{folder}/out"), f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), f"{folder}/state"


_FLOW = ("flow_id", "direction_key", "first_seq", "last_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count", "payload_byte_count",
         "forward_packet_count", "reverse_packet_count", "forward_bytes", "reverse_bytes", "syn_count", "syn_ack_count", "ack_count", "fin_count", "rst_count", "psh_count",
         "direction", "is_complete")


@query("stream_flows", B.with_views(f"select {', '.join(_FLOW)}, round(start_time,3)+0.0 as start_time, round(end_time,3)+0.0 as end_time from flows", "flows"))
def stream_flows(spark, sf):
    """Flows of a finite stream, row by row: those it has closed, and those open in its state at the end."""
    log, schema, folder = _clocked_log(spark, "packets", B.packets(spark, sf))
    closed, state = _stateful(spark, log, schema, folder, lambda s: R.flow_stream(s, B.FLOW_PARAMS))
    out = R.drained_flows(closed, state)
    return out.select(*_FLOW, F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query("stream_late_packets", B.with_views("""
select count(*) as packets, count(*) filter (floor(ts/60) < floor(wm/60) - 59) as late from (
 select ts, max(ts) over (order by pkt_seq rows unbounded preceding) as wm from (select pkt_seq, ts - case when pkt_seq % 5 = 0 then 86400.0 else 0.0 end as ts from packets))""", "packets"))
def stream_late_packets(spark, sf):
    """Packets of a stream that came when their minute had left the hour's window; every fifth packet is a day late."""
    late = B.packets(spark, sf).withColumn("ts", F.col("ts") - F.when(F.col("pkt_seq") % 5 == 0, 86400.0).otherwise(0.0))
    log, _, _ = _clocked_log(spark, "packets", late)
    return R.late_counts(log, 3600.0, 60.0).agg(F.sum("packets").alias("packets"), F.sum("late").alias("late"))


@query("stream_dns_pairing", B.with_views("select pkt_seq, visibility, paired_nx from dpair", "dpair"))
def stream_dns_pairing(spark, sf):
    """The visibility of every message of a stream."""
    log, schema, folder = _clocked_log(spark, "messages", B.dns(spark, sf))
    out, _ = _stateful(spark, log, schema, folder, R.paired_stream)
    return out.select("pkt_seq", "visibility", (F.col("nxdomain") & (F.col("visibility") == "PAIRED")).alias("paired_nx"))


@query("stream_events_with_flows", B.with_views("""
select e.event_id, e.severity, f.packet_count, e.flow_id from evts e join flows f using (flow_id)""", "evts"))
def stream_events_with_flows(spark, sf):
    """Flows and their events stored in batches under one commit; every batch comes twice, and a third of the flows again in the next one."""
    log = BatchLog(spark, shared_folder(spark, "events"))
    flows = B.stored_flows(spark, sf)
    write = store_flows_and_events(log, B.events_of)
    part = F.pmod(F.xxhash64("flow_id"), F.lit(3))
    for n in range(3):
        batch = flows.filter(part.isin(n, max(n - 1, 0)))
        write(batch.unionByName(batch), n)
        write(batch, n)
    events, kept = log.table("events"), log.table("flows").select("flow_id", "packet_count")
    return events.join(kept, "flow_id").select("event_id", "severity", "packet_count", "flow_id")


@query("stream_sessions", B.with_views("""
select direction_key, count(*) as sessions, sum(n)::bigint as packets from (select direction_key, seg, count(*) as n from (
  select *, sum(case when lag_ts is null or ts-lag_ts >= 43200 then 1 else 0 end) over (partition by direction_key order by pkt_seq) as seg
  from (select *, lag(ts) over (partition by direction_key order by pkt_seq) as lag_ts from keyed)) group by all) group by direction_key""", "keyed"))
def stream_sessions(spark, sf):
    """Gap sessions of a finite stream, with those that were open at its end."""
    closed = _collected(spark, R.session_flows(R.event_time(_packets(spark, sf), "0 seconds"), B.FLOW_PARAMS.idle_sec))
    out = R.drained_sessions(closed, B.packets(spark, sf), B.FLOW_PARAMS.idle_sec)
    return out.groupBy("direction_key").agg(F.count("*").alias("sessions"), F.sum("packet_count").alias("packets"))


@query("stream_deduplicated", "select event_type, count(*) as n from events group by all")
def stream_deduplicated(spark, sf):
    """Every row arrives twice and is stored once."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = R.packet_stream(spark, sf, schema, "events.parquet")
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.col("ts").cast("timestamp"))
    out = _collected(spark, R.deduplicated(twice.withWatermark("at", "60 days"), "event_id"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))
