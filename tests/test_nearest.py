"""As-of joins and neighbourhoods against plain loops, with one key that holds a third of the rows."""

import numpy as np
from pyspark.sql import functions as F

from quietwire.operators import investigate as V
from quietwire.operators.clock import as_of
from quietwire.operators.events import neighbourhoods


def test_as_of_with_a_hot_key(spark):
    rng = np.random.default_rng(5)
    key = lambda i: 0 if i % 3 == 0 else int(rng.integers(1, 40))
    known = [(key(i), float(rng.integers(0, 3000)), i, f"v{i}") for i in range(900)]
    asked = [(key(i), float(rng.integers(-50, 3200)), i) for i in range(900)]
    left = spark.createDataFrame(asked, "k int, at double, id long").repartition(5)
    right = spark.createDataFrame(known, "k int, ts double, seq long, v string").repartition(5)
    got = {r.id: r.found for r in as_of(left, right, ["k"], "at", "ts", "seq", F.col("v"), 60.0, "found").collect()}
    for k, at, i in asked:
        earlier = [(ts, seq, v) for own, ts, seq, v in known if own == k and ts <= at]
        assert got[i] == (max(earlier)[2] if earlier else None)
    assert len(got) == 900 and as_of(left, right.limit(0), ["k"], "at", "ts", "seq", F.col("v"), 60.0, "found").filter("found is not null").count() == 0


def test_neighbourhoods_of_a_dense_flow(spark):
    rng = np.random.default_rng(7)
    rows = [(f"e{i:04d}", float(rng.integers(0, 1500)), None if i % 50 == 49 else "f0" if i % 3 == 0 else f"f{int(rng.integers(1, 9))}") for i in range(900)]
    frame = spark.createDataFrame(rows, "event_id string, timestamp double, flow_id string").repartition(6)
    got = {}
    for r in neighbourhoods(frame, 300.0, 8).orderBy("anchor_id", "place").collect():
        got.setdefault(r.anchor_id, []).append(r)
    for event, ts, flow in rows:
        near = sorted((t, e) for e, t, f in rows if f == flow and flow is not None and abs(t - ts) <= 300 and e != event)
        mine = got[event]
        assert [r.other_id for r in mine] == [event, *[e for _, e in near]][:8]
        assert {(r.found, r.truncated) for r in mine} == {(len(near) + 1, len(near) + 1 > 8)} and [r.place for r in mine] == list(range(1, len(mine) + 1))


def test_evidence_counts_more_events_than_are_listed(spark):
    rows = [(f"e{i:03d}", float(i), "f", "a", "b", 1, 2, 6, "LIVE", None, "eth0" if i % 4 else None, 0.5, 0.5 if i % 2 else None) for i in range(100)]
    records = spark.createDataFrame(rows, "event_id string, timestamp double, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
                                          "source_mode string, replay_file_identifier string, capture_interface string, anomaly_score double, confidence double")
    signals = spark.createDataFrame([("e050", 0)], "event_id string, number int")
    got = {r.anchor_id: r for r in V.investigations(records, signals, 20.0, 5).collect()}
    assert len(got) == 100
    for i in range(100):
        linked = [j for j in range(100) if j % 4 and abs(i - j) <= 20] if i % 4 else [i]
        expected = len(linked) + sum(j % 2 for j in linked) + (50 in linked)
        assert got[f"e{i:03d}"].evidence_count == expected and len(got[f"e{i:03d}"].event_ids.split(";")) <= 5
