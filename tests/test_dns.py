import struct

import pytest
from pyspark.sql import functions as F

from quietwire.functions import lexical as X
from quietwire.operators import dns as N
from quietwire.sources import messages as M
from tests.wire import decoded

COLUMNS = ("pkt_seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, transaction_id int, qr boolean, "
           "rcode int, status string, questions array<struct<name:string,qtype:int,qclass:int>>")


def wire(txid=1, name="www.example.test", qtype=1, flags=0x0100, extra=b"", counts=(1, 0, 0, 0)):
    labels = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    return struct.pack("!6H", txid, flags, *counts) + labels + struct.pack("!HH", qtype, 1) + extra


def frame(spark, *messages):
    rows = []
    for i, (ts, qr, rcode, txid, name) in enumerate(messages):
        ends = ("198.51.100.53", "192.0.2.1", 53, 42000) if qr else ("192.0.2.1", "198.51.100.53", 42000, 53)
        rows.append((i, ts, *ends, 17, txid, qr, rcode, "PARSED", [(name, 1, 1)]))
    return spark.createDataFrame(rows, COLUMNS)


def visibility(spark, *messages):
    got = N.paired_messages(frame(spark, *messages)).orderBy("pkt_seq").collect()
    return [(r.visibility, r.paired_nx) for r in got]


def test_a_response_is_used_once(spark):
    got = visibility(spark, (0.0, False, 0, 1, "a.b"), (1.0, True, 3, 1, "a.b"), (2.0, True, 3, 1, "a.b"))
    assert got == [("QUERY_ONLY", False), ("PAIRED", True), ("RESPONSE_ONLY", False)]


@pytest.mark.parametrize("late,expected", [(10.0, "PAIRED"), (10.01, "RESPONSE_ONLY")])
def test_pairing_window_is_closed(spark, late, expected):
    assert visibility(spark, (0.0, False, 0, 1, "a.b"), (late, True, 0, 1, "a.b"))[1][0] == expected


def test_pairs_across_tiles_and_against_state(spark):
    import random

    rnd, t, rows = random.Random(2), 0.0, []
    for _ in range(800):
        t += rnd.choice([0.5, 1.0, 4.0, 9.0, 12.0])
        rows.append((t, rnd.random() < 0.5, rnd.choice([0, 3]), rnd.randrange(3), "a.b"))
    open_, expected = {}, []
    for ts, qr, _, txid, _ in rows:
        old = open_.get(txid)
        if old and old[1] != qr and ts - old[0] <= 10:
            expected.append("PAIRED")
            del open_[txid]
        else:
            expected.append("RESPONSE_ONLY" if qr else "QUERY_ONLY")
            open_[txid] = (ts, qr)
    assert [v for v, _ in visibility(spark, *rows)] == expected


def test_name_statistics(spark):
    s = spark.range(1).select(X.name_statistics(F.lit("ab12.ab12.example.test")).alias("s"), X.text_entropy(F.lit("aabb")).alias("e"),
                              X.text_entropy(F.lit("")).alias("z"), X.parent_name(F.lit("test")).alias("p")).first()
    assert (s.s.label_count, s.s.longest_label, s.s.repeated_labels, s.s.subdomain_depth_proxy) == (4, 7, 1, 2)
    assert s.s.digit_ratio == pytest.approx(4 / 19) and (s.e, s.z, s.p) == (1.0, 0.0, "test")


def test_reader_statuses():
    assert decoded(M.decode_dns, wire())["questions"] == [{"name": "www.example.test", "qtype": 1, "qclass": 1}]
    assert decoded(M.decode_dns, wire()[:-3])["status"] == "TRUNCATED"
    assert decoded(M.decode_dns, wire() + b"x")["status"] == "MALFORMED"
    assert decoded(M.decode_dns, wire(flags=0x0300))["status"] == "TRUNCATED"
    assert decoded(M.decode_dns, wire(flags=0x7900))["status"] == "UNSUPPORTED"
    loop = struct.pack("!6H", 1, 0x100, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    assert decoded(M.decode_dns, loop)["status"] == "MALFORMED"
    opt = b"\0" + struct.pack("!HHIH", 41, 1232, 1 << 24, 0)
    assert decoded(M.decode_dns, wire(flags=0x8180, extra=opt, counts=(1, 0, 0, 1)))["rcode"] == 16


def test_random_bytes_never_crash():
    import random

    rnd = random.Random(9)
    for _ in range(500):
        data = rnd.randbytes(rnd.randrange(80))
        assert decoded(M.decode_dns, data)["status"] in ("PARSED", "TRUNCATED", "MALFORMED", "UNSUPPORTED")
        assert decoded(M.decode_tls, data)["status"] and decoded(M.decode_quic, data or b"\0")["status"]


def test_messages_of_packets(spark):
    schema = "pkt_seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, fragment boolean, payload binary"
    two = b"".join(struct.pack("!H", len(m)) + m for m in (wire(1), wire(2)))
    rows = [(0, 0.0, "a", "b", 4000, 53, 17, False, bytearray(wire(7))), (1, 1.0, "a", "b", 4000, 53, 6, False, bytearray(two)),
            (2, 2.0, "a", "b", 4000, 853, 6, False, bytearray(b"x")), (3, 3.0, "a", "b", 4000, 80, 6, False, bytearray(b"x"))]
    got = M.dns_messages(spark.createDataFrame(rows, schema)).orderBy("pkt_seq", "transaction_id").collect()
    assert [(r.pkt_seq, r.status, r.transaction_id) for r in got] == [
        (0, "PARSED", 7), (1, "PARSED", 1), (1, "PARSED", 2), (2, "ENCRYPTED_OR_UNAVAILABLE", None)]
