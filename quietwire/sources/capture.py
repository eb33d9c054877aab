"""Capture files and frame decoding.

Frames are taken apart with binary expressions, which stay in generated code;
Python is used only to split capture files and to print IPv6 addresses.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magic numbers of the capture format -> (byte order, ticks per second).
CAPTURE_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6),
                 b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
ETHERTYPE_IPV4, ETHERTYPE_IPV6, VLAN_TYPES = 0x0800, 0x86DD, (0x8100, 0x88A8)


#: Bytes that one task reads, about.
RANGE_BYTES = 64 << 20
#: Records that must follow one another for a place inside a file to count as a record's border, or all up to the end.
CHAIN = 24
FRAMES = "pkt_seq long, ts double, raw binary, wire_len int, cap_len int, source string"
_CHUNK, _BATCH = 1 << 20, 4096


@dataclass
class _Range(InputPartition):
    """A slice of a capture file."""

    path: str
    number: int
    begin: int
    end: int


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class _Records:
    """The records of one capture file by their places."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        head = self.bytes_at(0, 24)
        self.order, self.ticks = CAPTURE_MAGIC.get(bytes(head[:4]), (None, None))
        if self.order is None:
            raise ValueError("not a capture file")
        self.most = struct.unpack(self.order + "I", head[16:20])[0] or 1 << 18

    def bytes_at(self, place: int, count: int) -> bytes:
        self.file.seek(place)
        return self.file.read(count)

    def plausible(self, raw: np.ndarray) -> np.ndarray:
        """Places of ``raw`` at which sixteen bytes can be a record's header: a fraction below a second, no more kept than was on the wire and than the file keeps."""
        if len(raw) < 16:
            return np.zeros(0, np.int64)
        fields = np.lib.stride_tricks.sliding_window_view(raw, 16).reshape(-1, 16)
        number = lambda i: fields[:, i:i + 4].copy().view(self.order + "u4")[:, 0].astype(np.int64)
        kept, wire = number(8), number(12)
        return np.flatnonzero((number(4) < self.ticks) & (kept <= wire) & (kept <= self.most) & (wire > 0))

    def is_border(self, place: int) -> bool:
        """Whether a chain of plausible records, with times that do not jump by more than a day, starts at ``place``."""
        before = None
        for _ in range(CHAIN):
            if place == self.size:
                return True
            head = self.bytes_at(place, 16)
            if len(head) < 16:
                return False
            sec, frac, kept, wire = struct.unpack(self.order + "IIII", head)
            if frac >= self.ticks or kept > wire or kept > self.most or (before is not None and abs(sec - before) > 86_400):
                return False
            before, place = sec, place + 16 + kept
            if place > self.size:
                return False
        return True

    def first_border(self, begin: int) -> int:
        """The first border at or behind ``begin``, or the end of the file."""
        if begin <= 24:
            return 24
        at = begin
        while at < self.size:
            raw = np.frombuffer(self.bytes_at(at, _CHUNK + 15), np.uint8)
            for place in self.plausible(raw).tolist():
                if self.is_border(at + place):
                    return at + place
            at += max(len(raw) - 15, 1)
        return self.size

    def frames(self, begin: int, end: int) -> Iterator[tuple[int, float, bytes, int, int]]:
        """(place, time, bytes, length on the wire, length kept) of the records that start in a range; a record that was cut off ends the file."""
        at = self.first_border(begin)
        held, start = b"", at
        while at < end:
            if at + 16 - start > len(held):
                held, start = self.bytes_at(at, _CHUNK), at
            if len(held) - (at - start) < 16:
                return
            sec, frac, kept, wire = struct.unpack_from(self.order + "IIII", held, at - start)
            if at + 16 + kept - start > len(held):
                held, start = self.bytes_at(at, max(_CHUNK, 16 + kept)), at
            frame = held[at - start + 16:at - start + 16 + kept]
            if len(frame) < kept:
                return
            yield at, sec + frac / self.ticks, frame, wire, kept
            at += 16 + kept


class _CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        files, root = _file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        named = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".pcap"))
        return [_Range(path, number, begin, min(begin + self.size, size)) for number, (path, size) in enumerate(named) for begin in range(0, max(size, 1), self.size)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.path)
        names = [f.split()[0] for f in FRAMES.split(", ")]

        def batch(rows: list) -> pa.RecordBatch:
            place, ts, raw, wire, kept = zip(*rows)
            numbers = (np.array(place, np.int64) >> 4) + (partition.number << 40)  # records lie sixteen bytes apart at least
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(ts, pa.float64()), pa.array(raw, pa.binary()), pa.array(wire, pa.int32()),
                                               pa.array(kept, pa.int32()), pa.array(["pcap"] * len(rows))], names=names)

        with files.open_input_file(partition.path) as file:
            rows = []
            for row in _Records(file, files.get_file_info(partition.path).size).frames(partition.begin, partition.end):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class CaptureFiles(DataSource):
    """Frames of the capture files below ``path``, in ranges of ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "capture_files"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _CaptureReader(self.options)


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A2: frames of all ``.pcap`` files below ``path``; a task reads one range of a file, however large the file is.

    A range begins at the first record border behind its first byte, found by the chain of records that follows, and takes the records that start
    in it. Arrival numbers are (file, place of the record in it): they rise along a file, and files are numbered by name.
    """
    spark.dataSource.register(CaptureFiles)
    return spark.read.format("capture_files").option("path", path).option("range_bytes", range_bytes).load()


def _uint(raw: Column, at: Column, size: int) -> Column:
    """Big-endian unsigned number of ``size`` bytes at zero-based offset ``at``."""
    return F.conv(F.hex(F.substring(raw, at.cast("int") + 1, F.lit(size))), 16, 10).cast("long")


def _network(raw: Column) -> tuple[Column, Column]:
    """Ethertype after at most two VLAN tags, and the offset of the network header."""
    kind, at = _uint(raw, F.lit(12), 2), F.lit(14)
    for _ in range(2):
        tagged = kind.isin(*VLAN_TYPES)
        kind, at = F.when(tagged, _uint(raw, at + 2, 2)).otherwise(kind), F.when(tagged, at + 4).otherwise(at)
    return kind, at


def non_ip(frames: DataFrame) -> DataFrame:
    """A4: frames that carry neither IPv4 nor IPv6."""
    kind, _ = _network(F.col("raw"))
    return frames.filter(~F.coalesce(kind.isin(ETHERTYPE_IPV4, ETHERTYPE_IPV6), F.lit(False)))


@F.pandas_udf(T.StringType())
def ipv6_text(address: pd.Series) -> pd.Series:
    """Sixteen bytes as compressed IPv6 text."""
    import ipaddress

    return address.map(lambda b: str(ipaddress.IPv6Address(bytes(b))) if b is not None and len(b) == 16 else None)


@F.pandas_udf(T.DoubleType())
def byte_entropy(payload: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes, 0 for none."""
    def one(b) -> float:
        if b is None or len(b) == 0:
            return 0.0
        counts = np.bincount(np.frombuffer(b, dtype=np.uint8))
        share = counts[counts > 0] / len(b)
        return float(-(share * np.log2(share)).sum())

    return payload.map(one)


def decode(frames: DataFrame, with_entropy: bool = False) -> DataFrame:
    """IP frames to packet rows, with the transport payload; other frames drop out."""
    raw = F.col("raw")
    kind, at = _network(raw)
    f = frames.withColumns({"kind": kind, "at": at}).filter(F.col("kind").isin(ETHERTYPE_IPV4, ETHERTYPE_IPV6))
    at, v6 = F.col("at"), F.col("kind") == ETHERTYPE_IPV6
    header = F.when(v6, 40).otherwise((_uint(raw, at, 1) % 16) * 4)
    total = F.when(v6, _uint(raw, at + 4, 2) + 40).otherwise(_uint(raw, at + 2, 2))
    f = f.withColumns({
        "protocol": F.when(v6, _uint(raw, at + 6, 1)).otherwise(_uint(raw, at + 9, 1)).cast("int"),
        "ttl": F.when(v6, _uint(raw, at + 7, 1)).otherwise(_uint(raw, at + 8, 1)).cast("int"),
        "l4": (at + header).cast("int"),
        "ip_total_length": F.when(total == 0, F.length(raw)).otherwise(total).cast("int"),
        "fragment": ~v6 & ((_uint(raw, at + 6, 2) % 8192) > 0)})
    f = f.withColumn("end", F.least(F.length(raw), at + F.col("ip_total_length")))
    l4, tcp = F.col("l4"), (F.col("protocol") == 6) & ~F.col("fragment")
    udp, icmp = (F.col("protocol") == 17) & ~F.col("fragment"), (F.col("protocol") == 1) & ~F.col("fragment")
    ports = tcp | udp
    body = (F.when(tcp, l4 + F.shiftright(_uint(raw, l4 + 12, 1), 4) * 4).when(udp | icmp, l4 + 8).otherwise(l4)).cast("int")

    def address(v4_at: int, v6_at: int) -> Column:
        parts = [_uint(raw, at + v4_at + i, 1).cast("string") for i in range(4)]
        return F.when(v6, ipv6_text(F.when(v6, F.substring(raw, at + v6_at + 1, F.lit(16))))).otherwise(F.concat_ws(".", *parts))

    f = f.withColumns({
        "src_ip": address(12, 8), "dst_ip": address(16, 24),
        "src_port": F.when(ports, _uint(raw, l4, 2)).cast("int"), "dst_port": F.when(ports, _uint(raw, l4 + 2, 2)).cast("int"),
        "tcp_flags": F.when(tcp, _uint(raw, l4 + 13, 1)).cast("int"), "tcp_window": F.when(tcp, _uint(raw, l4 + 14, 2)).cast("int"),
        "tcp_seq": F.when(tcp, _uint(raw, l4 + 4, 4)), "tcp_ack": F.when(tcp, _uint(raw, l4 + 8, 4)), "body": body})
    payload = F.substring(raw, F.col("body") + 1, F.greatest(F.col("end") - F.col("body"), F.lit(0)))
    out = f.withColumn("payload", payload).withColumn("payload_size", F.length("payload"))
    if with_entropy:
        out = out.withColumn("payload_entropy", byte_entropy("payload"))
    names = ["pkt_seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", "ip_total_length", "payload_size",
             "tcp_flags", "tcp_window", "tcp_seq", "tcp_ack", "fragment", "payload"]
    return out.select(*names, *(["payload_entropy"] if with_entropy else []))


def parse_counts(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """A5: frames read, packets parsed, frames skipped."""
    from quietwire.operators.clock import with_scalars

    both = with_scalars(frames.agg(F.count("*").alias("packet_count")), packets.agg(F.count("*").alias("parsed_count")))
    return both.withColumn("skipped_count", F.col("packet_count") - F.col("parsed_count"))
