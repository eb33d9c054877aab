import random

import numpy as np
import pytest

from quietwire import schema as S
from quietwire.functions import keys as K
from quietwire.operators.features import flow_features
from quietwire.operators.flows import SEGMENT, flow_packets, flows, gap_sessions, inter_arrivals
from quietwire.schema import FlowParams

A, B = "10.0.0.1", "192.0.2.9"


def tcp(ts, flags=16, back=False, length=100, payload=50):
    ends = (B, A, 80, 4000) if back else (A, B, 4000, 80)
    return (ts, *ends, 6, length, payload, flags)


def noisy_capture(n, seed, late):
    rnd, t, rows = random.Random(seed), 1000.0, []
    for _ in range(n):
        t += rnd.choice([0.01, 0.3, 0.5, 1.0, 2.0]) if rnd.random() < 0.98 else 130.0
        k = rnd.randrange(12)
        ends = ((f"10.0.0.{k % 3}", 4000 + k), ("192.0.2.1", 80))
        (si, sp), (di, dp) = ends if rnd.random() < 0.6 else ends[::-1]
        flags = rnd.choices([2, 18, 16, 24, 17, 4], [1, 1, 8, 4, 2, 1])[0]
        rows.append((round(t - rnd.random() * late, 3), si, di, sp, dp, 6, 40 + rnd.randrange(100), rnd.randrange(50), flags))
    return rows


def cut_by_state(rows, idle, grace):
    """Flow number of every packet, one packet after the other."""
    active, top, number, out = {}, float("-inf"), 0, []
    for ts, si, di, sp, dp, _, _, _, flags in rows:
        top, key = max(top, ts), frozenset([(si, sp), (di, dp)])
        flow = active.get(key)
        if flow and (top - flow["last"] >= idle or (flow["fin"] is not None and top - flow["fin"] >= grace)):
            flow = None
        if flow is None:
            flow, number = {"id": number, "last": ts, "fin": None}, number + 1
        flow["last"] = max(flow["last"], ts)
        if flags & 1 and flow["fin"] is None:
            flow["fin"] = ts
        out.append(flow["id"])
        active[key] = None if flags & 4 or (flags & 1 and grace == 0) else flow
    return out


@pytest.mark.parametrize("late,grace,in_order", [(0, 1.0, True), (0, 0.0, True), (0, 5.0, False), (0.5, 1.0, False), (3, 1.0, False), (150, 0.0, False), (400, 0.0, False)])
def test_cut_equals_state_machine(spark, packet_frame, late, grace, in_order):
    rows = noisy_capture(1500, 7, late)
    expected = cut_by_state(rows, 120.0, grace)
    got = flow_packets(packet_frame(*rows), FlowParams(120.0, grace), in_order).select("pkt_seq", *SEGMENT).collect()
    assert len(got) == len(rows)
    there, back = {}, {}
    for r in got:
        assert there.setdefault(tuple(r[1:]), expected[r[0]]) == expected[r[0]]
        assert back.setdefault(expected[r[0]], tuple(r[1:])) == tuple(r[1:])


@pytest.mark.parametrize("late,in_order", [(0, True), (2, False)])
def test_hot_conversation_with_many_fins(spark, packet_frame, late, in_order):
    """One conversation holds a third of all packets, most of them FINs, some within and some beyond the grace of one another."""
    rnd, t, rows = random.Random(21), 1000.0, []
    for i in range(9000):
        t += rnd.choice([0.1, 0.3, 0.6, 1.5])
        hot = i % 3 == 0
        rows.append((round(t - rnd.random() * late, 3), "10.0.0.1" if hot else f"10.1.{i % 50}.2", "192.0.2.1", 5000, 80, 6, 60, 10, 17 if hot and rnd.random() < 0.9 else 16))
    expected = cut_by_state(rows, 120.0, 1.0)
    got = flow_packets(packet_frame(*rows), FlowParams(120.0, 1.0), in_order).select("pkt_seq", *SEGMENT).collect()
    pairs = {(expected[r[0]], tuple(r[1:])) for r in got}
    assert len(got) == len(rows) and len(pairs) == len(set(expected)) == len({p[1] for p in pairs})


def counted(frame, params=FlowParams(120.0, 1.0)):
    return flows(frame, params).orderBy("first_seq").collect()


def test_idle_boundary_starts_a_flow(packet_frame):
    assert len(counted(packet_frame(tcp(1000.0), tcp(1120.0)))) == 2
    assert len(counted(packet_frame(tcp(1000.0), tcp(1119.9)))) == 1


def test_fin_keeps_the_grace_period(packet_frame):
    got = counted(packet_frame(tcp(0.0, 17), tcp(0.5), tcp(1.0)))
    assert [f.packet_count for f in got] == [2, 1]


def test_rst_belongs_to_the_closed_flow(packet_frame):
    got = counted(packet_frame(tcp(0.0), tcp(0.1, 4), tcp(0.2)))
    assert [(f.packet_count, f.rst_count, f.is_complete) for f in got] == [(2, 1, True), (1, 0, False)]


def test_first_packet_defines_forward(packet_frame):
    (f,) = counted(packet_frame(tcp(0.0, back=True), tcp(0.1, back=True)))
    assert (f.direction, f.src_ip, f.src_port, f.reverse_packet_count) == ("forward", B, 80, 0)
    (f,) = counted(packet_frame(tcp(0.0, back=True, length=60), tcp(0.1, length=40)))
    assert (f.direction, f.forward_bytes, f.reverse_bytes) == ("bidirectional", 60, 40)


def test_late_packet_moves_only_the_start(packet_frame):
    (f,) = counted(packet_frame(tcp(10.0), tcp(9.5), tcp(10.2)))
    assert (f.start_time, f.end_time) == (9.5, 10.2)


def test_syn_ack_is_not_a_syn(packet_frame):
    (f,) = counted(packet_frame(tcp(0.0, 2), tcp(0.1, 18, back=True)))
    assert (f.syn_count, f.syn_ack_count, f.ack_count) == (1, 1, 1)


def test_missing_ports_use_minus_one(packet_frame):
    frame = packet_frame((0.0, A, B, None, None, 1, 84, 56, None))
    assert frame.select(K.direction_key()).first()[0] == f"{A}:-1-{B}:-1-1"
    assert frame.select(K.unidirectional_key()).first()[0] == f"{A}:None-{B}:None-1"
    (f,) = counted(frame)
    assert (f.src_ip, f.src_port, f.protocol) == (A, None, 1)


def test_ipv6_endpoints_survive_the_key(packet_frame):
    (f,) = counted(packet_frame((0.0, "2001:db8::1", "2001:db8::2", 5000, 443, 6, 60, 0, 2)))
    assert (f.src_ip, f.dst_ip, f.src_port, f.dst_port) == ("2001:db8::1", "2001:db8::2", 5000, 443)


def test_no_gaps_give_zeros_and_zero_duration_gives_zero_rates(packet_frame):
    f = flow_features(packet_frame(tcp(5.0)), FlowParams()).first()
    assert f.iat_mean == f.iat_median == f.rev_iat_max == f.packets_per_sec == f.fwd_rev_byte_ratio == 0.0
    assert (f.pkt_size_mean, f.ip_version, f.is_tcp) == (100.0, 4.0, 1.0)


def test_features_against_numpy(spark, packet_frame):
    rng = np.random.default_rng(3)
    rows = [tcp(float(i), 16, bool(rng.integers(2)), int(rng.integers(40, 1500))) for i in np.cumsum(rng.random(200) * 3)]
    rows[0] = tcp(rows[0][0])
    f = flow_features(packet_frame(*rows), FlowParams(), in_order=True).first()
    sizes = np.array([r[6] for r in rows])
    fwd = np.diff([r[0] for r in rows if r[3] == 4000])
    rev = np.diff([r[0] for r in rows if r[3] == 80])
    both = np.concatenate([fwd, rev])
    expected = {"pkt_size_std": sizes.std(), "pkt_size_p25": np.percentile(sizes, 25), "pkt_size_p90": np.percentile(sizes, 90),
                "iat_mean": both.mean(), "iat_std": both.std(), "iat_median": np.median(both), "fwd_iat_max": fwd.max(), "rev_iat_std": rev.std()}
    for name, value in expected.items():
        assert f[name] == pytest.approx(value), name
    assert len([c for c in S.FEATURES]) == 52


def test_gaps_cross_tiles(packet_frame):
    params = FlowParams(10.0, 1.0)
    frame = packet_frame(*[tcp(float(t)) for t in range(0, 60, 6)])
    gaps = inter_arrivals(flow_packets(frame, params, True), params, True)
    assert sorted(r.iat for r in gaps.collect()) == [6.0] * 9


def test_gap_sessions(packet_frame):
    got = gap_sessions(packet_frame(tcp(0.0), tcp(5.0), tcp(15.0), tcp(15.5)), 10.0).orderBy("start_time").collect()
    assert [(r.packet_count, r.start_time) for r in got] == [(2, 0.0), (2, 15.0)]


@pytest.mark.parametrize("late,in_order", [(0, True), (2, False)])
def test_gap_medians_equal_plain_medians(spark, packet_frame, late, in_order):
    frame, params = packet_frame(*noisy_capture(600, 3, late)), FlowParams()
    key = lambda r: (r.direction_key, r.epoch, r.rst_no, r.fin_no)
    gaps = {}
    for r in inter_arrivals(flow_packets(frame, params, in_order), params, in_order).collect():
        gaps.setdefault(key(r), []).append(r.iat)
    got = {key(r): r.iat_median for r in flow_features(frame, params, in_order).select(*SEGMENT, "iat_median").collect()}
    assert len(got) > 50 and got == pytest.approx({k: float(np.median(gaps[k])) if k in gaps else 0.0 for k in got})


def test_many_flows_of_one_tile_put_no_list_on_a_packet(spark, packet_frame):
    """Hundreds of flows end in one tile: packets carry a count of deadlines, and the segments are those of the state machine."""
    rnd, rows = random.Random(3), []
    for i in range(900):
        rows.append((1000.0 + i * 0.1, A, B, 4000, 80, 6, 60, 20, rnd.choice([16, 17, 17, 4, 24])))
    cut = flow_packets(packet_frame(*rows), FlowParams(120.0, 1.0), True)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "_point" in plan and "marks" not in plan
    got = {r[0]: tuple(r[1:]) for r in cut.select("pkt_seq", *SEGMENT).collect()}
    expected = cut_by_state(rows, 120.0, 1.0)
    assert len(set(got.values())) == len(set(expected))
    assert len({(got[i], expected[i]) for i in range(900)}) == len(set(expected)) > 150
