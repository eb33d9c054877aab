import hashlib
import itertools
import struct

import pytest
from pyspark.sql import functions as F

from quietwire.operators import encrypted as T
from quietwire.schema import EncryptedParams
from quietwire.sources import encode as E
from quietwire.sources import messages as M
from tests.wire import decoded


def vec(n, data):
    return len(data).to_bytes(n, "big") + data


def client_hello(ciphers=(2570, 4865, 4866), groups=(29, 23), sni=b"Example.test", alpn=(b"h2", b"http/1.1")):
    ext = struct.pack("!H", 0) + vec(2, vec(2, b"\0" + vec(2, sni)))
    ext += struct.pack("!H", 10) + vec(2, vec(2, b"".join(g.to_bytes(2, "big") for g in groups)))
    ext += struct.pack("!H", 11) + vec(2, vec(1, b"\0"))
    ext += struct.pack("!H", 16) + vec(2, vec(2, b"".join(vec(1, a) for a in alpn)))
    ext += struct.pack("!H", 43) + vec(2, vec(1, b"\x03\x04"))
    body = b"\x03\x03" + bytes(32) + vec(1, b"") + vec(2, b"".join(c.to_bytes(2, "big") for c in ciphers)) + vec(1, b"\0") + vec(2, ext)
    handshake = b"\x01" + vec(3, body)
    return b"\x16\x03\x01" + vec(2, handshake)


def server_hello(cipher=4865):
    body = b"\x03\x03" + bytes(32) + vec(1, b"") + cipher.to_bytes(2, "big") + b"\0" + vec(2, struct.pack("!H", 43) + vec(2, b"\x03\x04"))
    return b"\x16\x03\x03" + vec(2, b"\x02" + vec(3, body))


def test_client_hello_fields():
    h = decoded(M.decode_tls, client_hello())
    assert (h["status"], h["handshake_type"], h["legacy_version"], h["sni"]) == ("COMPLETE", 1, 771, "example.test")
    assert (h["ciphers"], h["groups"], h["point_formats"], h["supported_versions"]) == ([2570, 4865, 4866], [29, 23], [0], [772])
    assert (h["extensions"], h["alpn"]) == ([0, 10, 11, 16, 43], ["h2", "http/1.1"])


@pytest.mark.parametrize("data,status", [
    (b"\x17\x03\x03\x00\x20", "ENCRYPTED_APPLICATION_DATA"), (b"\x15\x03\x03\x00\x02\x01\x00", "UNAVAILABLE"),
    (b"\x14\x03\x03\x00\x01\x02", "MALFORMED"), (b"\x16\x03\x01\x00\x00", "MALFORMED"), (b"GET / HTTP", "INCOMPLETE"),
    (b"\x16\x03\x01\x00\x04\x0b\x00\x00\x00", "UNSUPPORTED")])
def test_record_statuses(data, status):
    assert decoded(M.decode_tls, data)["status"] == status


def test_fingerprint_drops_filler_values(spark):
    rows = [(1, 771, [2570, 4865, 49199], [0, 10, 11], [29, 23], [0], [])]
    schema = "handshake_type int, legacy_version int, ciphers array<int>, extensions array<int>, groups array<int>, point_formats array<int>, supported_versions array<int>"
    got = T.fingerprints(spark.createDataFrame(rows, schema)).first()
    assert got.canonical == "771,4865-49199,0-10-11,29-23,0" and got.family == "JA3"
    assert got.digest == hashlib.md5(got.canonical.encode()).hexdigest()


def test_published_fingerprint(spark):
    """The worked example of the JA3 description."""
    rows = [(1, 769, [47, 53, 5, 10, 49161, 49162, 49171, 49172, 50, 56, 19, 4], [0, 10, 11], [23, 24, 25], [0], [])]
    schema = "handshake_type int, legacy_version int, ciphers array<int>, extensions array<int>, groups array<int>, point_formats array<int>, supported_versions array<int>"
    assert T.fingerprints(spark.createDataFrame(rows, schema)).first().digest == "ada70206e40642a3e4461f35503241d5"


def beginnings(spark, directions, reach=M.HELLO_REACH):
    """What ``stream_beginnings`` makes of lists of (sequence number, bytes) in arrival order."""
    rows = [(k, i, seq, bytearray(data)) for k, parts in directions.items() for i, (seq, data) in enumerate(parts)]
    found = M.stream_beginnings(spark.createDataFrame(rows, "k int, pkt_seq long, seq long, payload binary"), ["k"], reach).collect()
    return {r.k: (bytes(r.prefix), r.conflict, r.far) for r in found}


def test_segments_in_any_order(spark):
    data, wrap = client_hello(), 2 ** 32
    cuts = [(0, data[:30]), (20, data[20:70]), (70, data[70:]), (20, data[20:70])]
    orders = dict(enumerate(itertools.permutations(cuts)))
    got = beginnings(spark, {k: [((wrap - 40 + at) % wrap, part) for at, part in order] for k, order in orders.items()})
    assert len(got) == 24 and set(got.values()) == {(data, False, False)}


def test_holes_conflicts_and_reach(spark):
    got = beginnings(spark, {1: [(0, b"abc"), (1, b"xc")], 2: [(0, b"abc"), (200, b"x"), (3, b"d")], 3: [(5, b"b"), (6, b"c"), (4, b"a"), (8, b"e")],
                             4: [(0, b"ab"), (1, b"bcd"), (0, b"abcdef"), (2, b"XX")], 5: [(10, b"a" * 90), (101, b"y")]}, 100)
    assert got[1][1] and got[4][1]
    assert got[2] == (b"abcd", False, True) and got[3] == (b"abc", False, False) and got[5] == (b"a" * 90, False, False)


def test_many_retransmissions_of_one_direction(spark):
    data = client_hello()
    parts = [(i % 7 * 25, data[i % 7 * 25:i % 7 * 25 + 40]) for i in range(4000)]
    assert beginnings(spark, {1: parts})[1] == (data[:190][:max(at + len(d) for at, d in parts)], False, False)


def test_hellos_of_packets(spark, packet_frame):
    data, back = client_hello(), server_hello()
    a, b = ("10.0.0.1", "192.0.2.1", 5000, 443), ("192.0.2.1", "10.0.0.1", 443, 5000)
    parts = [(1.0, a, 2, b"", 99), (1.1, a, 16, data[40:], 140), (1.2, a, 16, data[:40], 100), (1.3, b, 16, back, 500), (1.4, a, 16, data[:40], 100)]
    schema = ("pkt_seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ip_total_length int, payload_size int, "
              "tcp_flags int, tcp_seq long, payload binary")
    frame = spark.createDataFrame([(i, t, *ends, 6, 40 + len(d), len(d), f, s, bytearray(d)) for i, (t, ends, f, d, s) in enumerate(parts)], schema)
    rows = T.connection_packets(frame, EncryptedParams())
    got = M.tls_hellos(rows).orderBy("handshake_type").collect()
    assert [(r.status, r.handshake_type, r.sni) for r in got] == [("COMPLETE", 1, "example.test"), ("COMPLETE", 2, None)]
    signals = T.hello_signals(M.tls_hellos(rows), "conn_seq").groupBy("signal_type").count().collect()
    assert {r.signal_type: r["count"] for r in signals}["TLS_ALPN_CONTEXT"] == 1
    timing = T.connection_timing(rows).first()
    assert (timing.packets, timing.direction_count, timing.gap_max) == (5, 2, pytest.approx(0.1))


def test_timing_covers_all_packets_of_a_long_connection(spark, packet_frame):
    times = [round(i * 0.7 + (i % 7) * 0.05, 3) for i in range(300)]
    rows = T.connection_packets(packet_frame(*[(t, "10.0.0.1", "192.0.2.1", 5000, 443, 6, 60 + i % 9, 0, 16) for i, t in enumerate(times)]), EncryptedParams())
    gaps = [b - a for a, b in zip(times, times[1:])]
    r = T.connection_timing(rows, 60.0).first()
    assert (r.packets, r.sample_count, r.packet_size_max, r.direction_count) == (300, 300, 68, 1)
    assert (r.gap_mean, r.gap_min, r.gap_max) == (pytest.approx(sum(gaps) / 299), pytest.approx(min(gaps)), pytest.approx(max(gaps)))


def test_new_syn_starts_a_connection(spark, packet_frame):
    def p(ts, flags):
        return (ts, "10.0.0.1", "192.0.2.1", 5000, 443, 6, 60, 0, flags)

    rows = T.connection_packets(packet_frame(p(0, 2), p(1, 2), p(2, 16), p(3, 17), p(4, 16), p(5, 2), p(70, 16), p(71, 2)), EncryptedParams())
    assert [r.conn_seq for r in rows.orderBy("pkt_seq").collect()] == [0, 0, 0, 0, 0, 5, 6, 7]


def test_name_visibility(spark):
    rows = spark.createDataFrame([("a", [65037]), (None, [65037]), ("a", [0]), (None, [0])], "sni string, e array<int>")
    got = [r[0] for r in rows.select(T.name_visibility(F.col("sni"), F.col("e"))).collect()]
    assert got == ["outer_name_only_ech_extension_observed", "unavailable_ech_extension_observed", "plaintext_observed", "not_observed"]


def quic_initial(token=b"tt"):
    return b"\xc3" + (1).to_bytes(4, "big") + vec(1, b"dddd") + vec(1, b"") + bytes([len(token)]) + token + b"\x05" + b"\0" * 5


def test_quic_headers(spark):
    h = decoded(M.decode_quic, quic_initial())
    assert (h["status"], h["packet_type"], h["token_length"], h["destination_cid"]) == (
        "COMPLETE", "INITIAL", 2, b"dddd")
    assert decoded(M.decode_quic, b"\x40abc")["status"] == "UNSUPPORTED"
    assert decoded(M.decode_quic, quic_initial()[:-2])["status"] == "TRUNCATED"
    assert decoded(M.decode_quic, b"\xc0" + bytes(4) + b"\0\0" + (1).to_bytes(4, "big"))["packet_type"] == "VERSION_NEGOTIATION"
    schema = "pkt_seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, payload binary"
    rows = [(0, 1.0, "a", "b", 5000, 443, 17, bytearray(quic_initial())), (1, 2.0, "a", "b", 5000, 443, 17, bytearray(b"\x40abc")),
            (2, 3.0, "b", "a", 443, 5000, 17, bytearray(b"\x40abc"))]
    first = M.quic_headers(spark.createDataFrame(rows, schema)).orderBy("pkt_seq").first()
    assert (first.destination_cid_sha256, first.source_cid_length, first.source_cid_sha256) == (hashlib.sha256(b"dddd").hexdigest(), 0, None)
    heads = T.latest_headers(M.quic_headers(spark.createDataFrame(rows, schema)), "direction_key", "lo_to_hi")
    got = {r.lo_to_hi: (r.status, r.last_packet_ts) for r in heads.collect()}
    assert got == {True: ("COMPLETE", 2.0), False: ("UNSUPPORTED", 3.0)}
    assert T.quic_status(heads, "direction_key", "lo_to_hi").first().quic_status == "COMPLETE"
    assert {r.signal_type for r in T.header_signals(heads, "direction_key").collect()} == {
        "QUIC_LONG_HEADER_OBSERVED", "QUIC_VERSION_CONTEXT", "QUIC_CONNECTION_ID_CONTEXT"}


def test_nested_parts_are_written_once(spark):
    """A length stands before its content; neither it nor a record mentions the content again, however deep the parts lie."""
    deep = E.tls_records(E.sized(E.tls_extension(16, E.sized(F.col("inner"), 2)), 3), 50)
    assert deep._jc.toString().count("inner") == 1
    inner = bytes(range(120))
    got = spark.createDataFrame([(inner,), (None,)], "inner binary").select(deep.alias("x")).collect()
    plain = lambda b, w: len(b).to_bytes(w, "big") + b
    stream = plain((16).to_bytes(2, "big") + plain(plain(inner, 2), 2), 3)
    assert bytes(got[0].x) == b"".join(b"\x16\x03\x01" + plain(stream[i:i + 50], 2) for i in range(0, len(stream), 50))
    assert got[1].x is None
