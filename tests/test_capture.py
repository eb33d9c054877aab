import struct

import pytest

from quietwire.sources import capture as C
from quietwire.sources import datasets


def ipv4(proto, body, src="10.0.0.1", dst="192.0.2.1", fragment=0):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, fragment, 64, proto, 0, *(bytes(map(int, a.split("."))) for a in (src, dst)))
    return head + body


def tcp(payload=b"", flags=24):
    return struct.pack("!HHIIBBHHH", 4000, 443, 7, 9, 0x50, flags, 1024, 0, 0) + payload


def udp(payload=b"xy"):
    return struct.pack("!HHHH", 5000, 53, 8 + len(payload), 0) + payload


def ether(kind, body, vlan=False):
    return bytes(12) + (b"\x81\x00\x00\x05" if vlan else b"") + kind.to_bytes(2, "big") + body


FRAMES = [
    ether(0x0800, ipv4(6, tcp(b"abcd"))), ether(0x0800, ipv4(17, udp()), vlan=True), ether(0x0806, bytes(28)),
    ether(0x86DD, struct.pack("!IHBB", 6 << 28, 10, 17, 61) + bytes.fromhex("20010db8" + "0" * 22 + "01") + bytes.fromhex("20010db8" + "0" * 22 + "02") + udp()),
    ether(0x0800, ipv4(1, b"\x08\0" + bytes(6) + b"ping")), ether(0x0800, ipv4(17, udp(), fragment=64))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    for name, order in (("b.pcap", ">"), ("a.pcap", "<")):
        data = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for i, f in enumerate(FRAMES):
            data += struct.pack(order + "IIII", 1000 + i, 500000, len(f), len(f)) + f
        (path / name).write_bytes(data)
    (path / "notes.txt").write_text("not a capture")
    return str(path)


def test_read_and_decode(spark, folder):
    frames = C.read_captures(spark, folder)
    rows = frames.orderBy("pkt_seq").collect()
    assert len(rows) == 12 and [r.pkt_seq for r in rows[:2]] == [24 >> 4, (24 + 16 + len(FRAMES[0])) >> 4] and rows[6].pkt_seq == (1 << 40) + 1
    assert rows[0].ts == 1000.5
    got = C.decode(frames, with_entropy=True).orderBy("pkt_seq").collect()[:5]
    assert [(r.protocol, r.src_port, r.dst_port, r.ip_total_length, r.payload_size) for r in got] == [
        (6, 4000, 443, 44, 4), (17, 5000, 53, 30, 2), (17, 5000, 53, 50, 2), (1, None, None, 32, 4), (17, None, None, 30, 10)]
    assert (got[0].tcp_flags, got[0].tcp_seq, got[0].tcp_window, bytes(got[0].payload), got[0].payload_entropy) == (24, 7, 1024, b"abcd", 2.0)
    assert (got[2].src_ip, got[2].dst_ip, got[2].ttl) == ("2001:db8::1", "2001:db8::2", 61)
    assert got[4].fragment


def test_non_ip_and_counts(spark, folder):
    frames = C.read_captures(spark, folder)
    assert C.non_ip(frames).count() == 2
    assert tuple(C.parse_counts(frames, C.decode(frames)).first()) == (12, 10, 2)


def test_ranges_of_a_file_give_the_same_frames(spark, tmp_path):
    """Payloads that look like record headers, and a last record that was cut off."""
    import random

    rnd = random.Random(6)
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i in range(3000):
        like = struct.pack("<IIII", 1000 + i, 5, 40, 60) * rnd.randrange(4)
        body = ether(0x0800, ipv4(17, udp(like + rnd.randbytes(rnd.randrange(300)))))
        data += struct.pack("<IIII", 1000 + i // 10, i % 10, len(body), len(body)) + body
    (tmp_path / "large.pcap").write_bytes(data + struct.pack("<IIII", 2000, 0, 100, 100) + b"cut")
    whole = C.read_captures(spark, str(tmp_path)).collect()
    assert len(whole) == 3000
    for parts in (7, 60):
        frames = C.read_captures(spark, str(tmp_path), len(data) // parts + 1)
        assert frames.rdd.getNumPartitions() >= parts
        assert sorted(map(tuple, frames.collect())) == sorted(map(tuple, whole))


def test_flow_tables(spark, tmp_path):
    cic = {"Flow Duration": 2e6, "Total Fwd Packets": 4.0, "Total Backward Packets": 0.0, "Fwd Packets Length Total": 100.0,
           "Bwd Packets Length Total": 0.0, "Flow Packets/s": 2.0, "Flow Bytes/s": 50.0, "Protocol": 6, "Label": "DoS Hulk"}
    for stat in ("Mean", "Std", "Min", "Max"):
        cic |= {f"Packet Length {stat}": 1.0, f"Flow IAT {stat}": 5e5, f"Fwd IAT {stat}": 5e5, f"Bwd IAT {stat}": 0.0}
    cic |= {f"{f} Flag Count": 2 for f in ("SYN", "ACK", "FIN", "RST", "PSH")}
    import pandas as pd

    pd.DataFrame([cic]).to_parquet(tmp_path / "monday-no-metadata.parquet")
    r = datasets.load_cic(spark, str(tmp_path)).first()
    assert (r.scenario, r.label, r.duration_sec, r.fwd_rev_packet_ratio, r.syn_ratio, r.is_tcp, r.iat_mean, r.ip_version) == (
        "monday", "ddos", 2.0, 4.0, 0.5, 1.0, 0.5, None)
    head = "id,dur,proto,spkts,dpkts,sbytes,dbytes,rate,sinpkt,dinpkt,attack_cat,label\n"
    (tmp_path / "UNSW_NB15_training-set.csv").write_bytes((head + "1,0,TCP,3,1,10,0,9,1,2,,1\n").encode("latin-1"))
    (tmp_path / "UNSW_NB15_testing-set.csv").write_bytes((head + "1,2,udp,3,1,10,5,9,1,2, Backdoor\xe9 ,1\n2,1,x,1,1,1,1,1,1,1,Normal,0\n").encode("latin-1"))
    got = {(r.scenario, r.label, r.protocol): r for r in datasets.load_unsw(spark, str(tmp_path)).collect()}
    assert set(got) == {("train", "other", 6.0), ("test", "unknown", 17.0), ("test", "benign", 0.0)}
    assert got[("train", "other", 6.0)].packets_per_sec == pytest.approx(4e6)
