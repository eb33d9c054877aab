import random

import pytest
from pyspark.sql import functions as F

from quietwire.operators import signals as G
from quietwire.operators import windows as W
from quietwire.operators.clock import arrival_watermark, exact_quantiles, late_rows, prefix_sums
from quietwire.operators.flows import flows
from quietwire.schema import FlowParams, WindowParams

LOW = WindowParams(syn_rate=0.1, udp_rate=0.1, udp_flow_rate=0.1, flow_rate=0.1, packet_rate=0.1, unique_sources=4, entropy_bits=1,
                   min_entropy_observations=2, port_fanout=4, host_fanout=4, directional_bytes=1000)
QUICK = FlowParams(idle_sec=5.0, fin_grace_sec=1.0)


def kinds(packets, params=LOW, flow_params=QUICK):
    flow = flows(packets, flow_params)
    got = G.behaviour_signals(W.flow_windows(packets, flow, flow_params, params), params)
    return {(r.signal_type, round(r.observed_value, 6)) for r in got.collect()}


def test_eight_equal_sources_are_three_bits(packet_frame):
    rows = [(100.0 + i, f"10.0.0.{i}", "192.0.2.1", 1000 + i, 80, 6, 60, 0, 2) for i in range(8)]
    got = kinds(packet_frame(*rows, (120.0, "10.9.9.9", "10.9.9.8", 1, 2, 17, 60, 0, None)))
    assert ("SOURCE_DISTRIBUTION_ENTROPY", 3.0) in got and ("UNIQUE_SOURCE_COUNT", 8.0) in got
    assert ("SYN_RATE", round(8 / 60, 6)) in got


@pytest.mark.parametrize("times,expected", [
    ([0, 8, 16, 24, 32, 40], True), ([0, 1, 4, 11, 25, 48], False), ([0, 8, 16], False)])
def test_periodic_sessions(packet_frame, times, expected):
    rows = [(1000.0 + t, "10.0.0.1", "192.0.2.1", 5000 + i, 443, 6, 60, 0, 4) for i, t in enumerate(times)]
    got = kinds(packet_frame(*rows))
    assert any(k == "C2_PERIODICITY_EVIDENCE" for k, _ in got) is expected


@pytest.mark.parametrize("head", [[], [0.0, 0.1, 4.0, 4.1, 9.0, 9.1, 13.0, 13.3]])
def test_gaps_of_all_sessions_in_the_window_count(packet_frame, head):
    """40 sessions and more of one pair: the newest are regular, the first ones may not be."""
    times = head + [15.0 + i for i in range(40)]
    packets = packet_frame(*[(1000.0 + t, "10.0.0.1", "192.0.2.1", 5000 + i, 443, 6, 60, 0, 4) for i, t in enumerate(times)])
    rows = W.flow_windows(packets, flows(packets, QUICK), QUICK, LOW).orderBy(F.desc("eval_tick")).first()
    gaps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    assert rows.n_times == len(times) and (rows.gap_mean, rows.gap_std) == (pytest.approx(mean), pytest.approx(std, abs=1e-6))


def test_equal_times_are_not_periodic(packet_frame):
    rows = [(1000.0, "10.0.0.1", "192.0.2.1", 5000 + i, 443, 6, 60, 0, 4) for i in range(6)]
    assert not any(k == "C2_PERIODICITY_EVIDENCE" for k, _ in kinds(packet_frame(*rows)))


def test_port_fanout(packet_frame):
    rows = [(1000.0 + i, "10.0.0.1", "192.0.2.1", 5000, 20 + i, 6, 60, 0, 4) for i in range(5)]
    assert ("PORT_FANOUT", 5.0) in kinds(packet_frame(*rows))


def test_asymmetry_needs_three_heavy_flows(packet_frame):
    def heavy(n):
        return packet_frame(*[(1000.0 + i, "10.0.0.1", "192.0.2.1", 5000 + i, 443, 6, 1500, 0, 4) for i in range(n)])

    assert ("DIRECTIONAL_ASYMMETRY", 4500.0) in kinds(heavy(3))
    assert not any(k == "DIRECTIONAL_ASYMMETRY" for k, _ in kinds(heavy(2)))


def test_idle_closed_flow_left_the_window(packet_frame):
    rows = [(1000.0, "10.0.0.1", "192.0.2.1", 5000, 443, 6, 60, 0, 16), (1200.0, "10.0.0.9", "192.0.2.1", 5001, 443, 6, 60, 0, 16)]
    frame = packet_frame(*rows)
    got = W.closing_ticks(flows(frame), frame, FlowParams(), WindowParams()).orderBy("first_seq").collect()
    assert (got[0].eval_tick, got[0].in_window) == (1200, False)


def test_trailing_values_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"k{min(rnd.randrange(6), 1)}", rnd.randrange(200), f"m{rnd.randrange(9)}", rnd.randrange(1, 4)) for _ in range(600)]
    members = spark.createDataFrame(rows, "k string, tick long, m string, n long").groupBy("k", "tick", "m").agg(F.sum("n").alias("n"))
    change = W.member_changes(members, ["k"], "m", 20, "m").unionByName(
        W.changes(members.groupBy("k", "tick").agg(F.sum("n").alias("n")), ["k"], ["n"], 20), allowMissingColumns=True)
    for r in W.values_at(change, members, ["k"], ["n", "m_distinct", "m_nlogn"]).collect():
        inside = [x for x in rows if x[0] == r.k and r.tick - 19 <= x[1] <= r.tick]
        assert r.n == sum(x[3] for x in inside)
        assert r.m_distinct == len({x[2] for x in inside})


def test_watermark_and_late_rows(packet_frame):
    times = [10.0, 12.0, 11.0, 300.0, 200.0, 301.0]
    frame = packet_frame(*[(t, "a", "b", 1, 2, 17, 60, 0, None) for t in times])
    got = late_rows(arrival_watermark(frame, block_rows=2), 60, 1).orderBy("pkt_seq").collect()
    assert [r.wm for r in got] == [10.0, 12.0, 12.0, 300.0, 300.0, 301.0]
    assert [r.is_late for r in got] == [False, False, False, False, True, False]


def test_prefix_sums_and_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 100, 500), np.full(300, 7.0), [-3.0, 0.0, 1e9]])
    frame = spark.createDataFrame([(i, float(v), int(v // 50)) for i, v in enumerate(values)], "i long, v double, b long")
    got = {r.i: r.c for r in prefix_sums(frame, "b", ["v", "i"], {"c": F.lit(1).cast("long")}).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert [got[i] for i in order] == list(range(1, len(values) + 1))
    q = exact_quantiles(frame, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).first()
    assert list(q) == pytest.approx([np.quantile(values, x) for x in (0, 0.25, 0.5, 0.95, 1)])
