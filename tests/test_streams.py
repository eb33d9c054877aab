import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quietwire.operators.flows import flows
from quietwire.schema import PACKET, FlowParams
from quietwire.streaming import streams as R
from test_flows import cut_by_state

from quietwire.streaming.batchlog import BatchLog, batch_stream, store_flows_and_events

def write_parts(spark, folder, rows, size):
    frame = spark.createDataFrame(rows, PACKET)
    for i in range(0, len(rows), size):
        frame.filter((F.col("pkt_seq") >= i) & (F.col("pkt_seq") < i + size)).coalesce(1).write.mode("append").parquet(folder)
    return frame


def capture():
    rnd, t, rows = random.Random(4), 1000.0, []
    for i in range(400):
        t += rnd.choice([0.2, 0.7, 2.0, 9.0])
        k = rnd.randrange(5)
        ends = ((f"10.0.0.{k}", 4000 + k), ("192.0.2.1", 80))
        (si, sp), (di, dp) = ends if rnd.random() < 0.6 else ends[::-1]
        rows.append((i, round(t, 3), si, di, sp, dp, 6, 60, 20, rnd.choice([2, 16, 16, 16, 17, 4])))
    # one late packet of another conversation closes everything by the clock
    return rows + [(400, t + 10000.0, "10.9.9.9", "192.0.2.1", 1, 80, 6, 60, 20, 16), (401, t + 20000.0, "10.9.9.9", "192.0.2.1", 1, 80, 6, 60, 20, 16)]


COLUMNS = ["flow_id", "src_ip", "dst_port", "start_time", "end_time", "packet_count", "forward_bytes", "reverse_bytes", "payload_byte_count", "syn_count", "fin_count",
           "rst_count", "last_seq", "direction", "is_complete"]


def clocked(spark, folder, frame, cuts):
    """A log of ``frame`` in batches that end before the arrival numbers ``cuts``."""
    log = BatchLog(spark, f"{folder}/log")
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 1 << 40])):
        R.clock_batches(log)(frame.filter((F.col("pkt_seq") >= low) & (F.col("pkt_seq") < high)), n)
    return log


def late_capture(late):
    """Packets of ``capture`` of which some arrive up to ``late`` seconds behind the clock."""
    rnd = random.Random(12)
    return [(i, round(ts - (rnd.random() * late if rnd.random() < 0.3 else 0), 3), *rest) for i, ts, *rest in capture()[:-2]]


@pytest.mark.parametrize("late,grace", [(0, 1.0), (15, 1.0), (40, 0.0)])
def test_a_stream_gives_exactly_the_flows_of_the_state_machine(spark, tmp_path, late, grace):
    params = FlowParams(20.0, grace)
    frame, rnd = spark.createDataFrame(late_capture(late), PACKET), random.Random(late)
    R.use_state_store(spark)
    log = BatchLog(spark, f"{tmp_path}/log")
    cuts = sorted(rnd.sample(range(1, 400), 3))
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 400])):  # a batch arrives, the stream goes on
        R.clock_batches(log)(frame.filter((F.col("pkt_seq") >= low) & (F.col("pkt_seq") < high)), n)
        stream = R.flow_stream(R.clocked_stream(log, frame.schema), params)
        R.run_to_end(stream, R.store_batches(f"{tmp_path}/out", "flow_id"), f"{tmp_path}/state")
    closed = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    got = R.drained_flows(closed, f"{tmp_path}/state").select(*COLUMNS).collect()
    held = {}
    for row, number in zip(late_capture(late), cut_by_state([r[1:] for r in late_capture(late)], 20.0, grace)):
        held.setdefault(number, []).append(row)
    expected = [(min(r[1] for r in f), max(r[1] for r in f), len(f), sum(r[9] & 1 for r in f), f[-1][0], f[0][2], f[0][5]) for f in held.values()]
    assert sorted((r.start_time, r.end_time, r.packet_count, r.fin_count, r.last_seq, r.src_ip, r.dst_port) for r in got) == sorted(expected)
    assert 0 < closed.count() < len(got) and sum(r.packet_count for r in got) == 400
    if late == 0:
        assert sorted(map(tuple, got)) == sorted(map(tuple, flows(frame, params).select(*COLUMNS).collect()))


def test_silent_flow_is_closed_without_data(spark, tmp_path):
    frame = spark.createDataFrame(capture()[:30], PACKET)
    log = clocked(spark, tmp_path, frame, [])
    R.use_state_store(spark)
    stream = R.flow_stream(R.clocked_stream(log, frame.schema), FlowParams(2.0, 0.5), without_data=True)
    query = stream.writeStream.foreachBatch(R.store_batches(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out") if os.path.isdir(f"{tmp_path}/out") else None
            if found is not None and (found.agg(F.sum("packet_count")).first()[0] or 0) == 30:
                break
    finally:
        query.stop()
    columns = [c for c in COLUMNS if c != "last_seq"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, flows(frame, FlowParams(2.0, 0.5)).select(*columns).collect()))


def test_drained_sessions_are_complete(spark, tmp_path):
    frame = write_parts(spark, str(tmp_path / "in"), capture()[:-2], 150)
    stream = R.event_time(R.packet_stream(spark, str(tmp_path / "in"), PACKET), "0 seconds")
    R.run_to_end(R.session_flows(stream, 20.0), R.store_batches(str(tmp_path / "sessions")), str(tmp_path / "b"))
    drained = R.drained_sessions(spark.read.parquet(str(tmp_path / "sessions")), frame, 20.0)
    assert drained.agg(F.sum("packet_count")).first()[0] == 400


def test_clock_and_late_packets_of_batches(spark, tmp_path):
    rows = late_capture(40)
    log = clocked(spark, tmp_path, spark.createDataFrame(rows, PACKET), [90, 200, 201])
    top, expected, late = 0.0, {}, 0
    for i, ts, *_ in rows:
        top = max(top, ts)
        expected[i] = top
        late += ts // 1 < top // 1 - 29
    assert {r.pkt_seq: r.wm for r in log.table("packets").collect()} == expected
    counts = R.late_counts(log, 30.0, 1.0).collect()
    assert sum(r.packets for r in counts) == 400 and sum(r.late for r in counts) == late > 0 and len(counts) == 4


def test_named_metric_counts_late_rows(spark, tmp_path):
    frame = spark.createDataFrame(late_capture(40), PACKET)
    log = clocked(spark, tmp_path, frame, [200])
    kept, _ = R.observed(R.clocked_stream(log, frame.schema), 30.0, 1.0, "arrivals")
    query = kept.writeStream.foreachBatch(R.store_batches(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [p["observedMetrics"]["arrivals"] for p in query.recentProgress if "arrivals" in p["observedMetrics"]]
    assert sum(t["packets"] for t in told) == 400 and sum(t["late"] for t in told) == sum(r.late for r in R.late_counts(log, 30.0, 1.0).collect())


def test_one_commit_for_two_tables(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path))
    write = store_flows_and_events(log, lambda f: f.select("flow_id", F.lit("e").alias("event")))
    make = lambda *ids: spark.createDataFrame([(i, i * 2, "x") for i in ids], "flow_id long, n long, key string")
    write(make(1, 2, 2), 0)
    write(make(7), 0)  # the batch again
    write(make(2, 3), 1)
    write(make(1, 4, 4), 2)
    assert sorted(r.flow_id for r in log.table("flows").collect()) == [1, 2, 3, 4] == sorted(r.flow_id for r in log.table("events").collect())
    assert {r.batch_id: r.facts["flows"] for r in log.facts().collect()} == {0: 2, 1: 1, 2: 1}
    make(9).write.parquet(f"{tmp_path}/flows/batch_id=3")  # written, not committed
    assert log.table("flows").count() == 4
    stream = batch_stream(log, "flows", "flow_id long, n long, key string")
    R.run_to_end(stream, R.store_batches(f"{tmp_path}/copy"), f"{tmp_path}/state")
    assert sorted(r.flow_id for r in spark.read.parquet(f"{tmp_path}/copy").collect()) == [1, 2, 3, 4]


def test_repeated_batches_do_not_double_rows(spark, tmp_path):
    seen = []
    write = R.store_batches(str(tmp_path), "id", lambda rows, n: seen.append((n, rows.count())))
    batch = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path)).count() == 2 and seen == [(0, 2), (0, 2)]


def paired_by_state(rows, ttl=10.0):
    """The visibility of every message, one after the other."""
    waiting, top, out = {}, float("-inf"), {}
    for seq, ts, txid, qr in rows:
        top = max(top, ts)
        held = waiting.get(txid)
        if held and held[0] < top - ttl:
            held = waiting.pop(txid) and None
        if held and held[1] != qr and abs(ts - held[0]) <= ttl:
            out[seq] = ("PAIRED", held[2])
            del waiting[txid]
        else:
            out[seq] = ("RESPONSE_ONLY" if qr else "QUERY_ONLY", None)
            if ts >= top - ttl:
                waiting[txid] = (ts, qr, seq)
    return out


def test_pairing_stream_equals_its_state_machine(spark, tmp_path):
    schema = ("pkt_seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, transaction_id int, qr boolean, "
              "rcode int, status string, questions array<struct<name:string,qtype:int,qclass:int>>")
    rnd, t, plain = random.Random(3), 100_000.0, []
    for i in range(400):
        t += rnd.choice([0.5, 1.0, 4.0, 9.0])
        plain.append((i, round(t - (rnd.random() * 25 if rnd.random() < 0.2 else 0), 2), rnd.randrange(3), rnd.random() < 0.5))
    rows = [(i, ts, *(("s", "c", 53, 42) if qr else ("c", "s", 42, 53)), 17, txid, qr, 3 * qr, "PARSED", [("a.b", 1, 1)]) for i, ts, txid, qr in plain]
    alone = [(400 + i, t, "c", "s", 42, 53, 17, 9, i % 2 == 1, 0, "PARSED", []) for i in range(4)]
    frame = spark.createDataFrame(rows + alone, schema)
    R.use_state_store(spark)
    log = BatchLog(spark, f"{tmp_path}/log")
    for n, (low, high) in enumerate([(0, 150), (150, 151), (151, 404)]):
        R.clock_batches(log)(frame.filter((F.col("pkt_seq") >= low) & (F.col("pkt_seq") < high)), n)
        R.run_to_end(R.paired_stream(R.clocked_stream(log, frame.schema)), R.store_batches(f"{tmp_path}/out"), f"{tmp_path}/state")
    got = {r.pkt_seq: (r.visibility, r.partner_seq) for r in spark.read.schema(R.PAIRED).parquet(f"{tmp_path}/out").collect()}
    expected = paired_by_state(plain) | {400 + i: ("RESPONSE_ONLY" if i % 2 else "QUERY_ONLY", None) for i in range(4)}
    assert got == expected and sum(v == "PAIRED" for v, _ in got.values()) > 50


def test_sliding_counts_batch(spark, packet_frame):
    frame = packet_frame((0.5, "a", "b", 1, 2, 17, 60, 0, None), (1.5, "a", "b", 1, 2, 17, 60, 0, None)).withColumn(
        "event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    got = R.sliding_counts(frame, "2 seconds", "1 second", "dst_ip").filter("packets = 2").count()
    assert got == 1
