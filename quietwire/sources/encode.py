"""Column expressions that write numbers, frames and messages as bytes: the way back from tables to what a capture holds.

Everything is built from binary built-ins, so that tables of any size become frames inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uint(value: Column | int, width: int) -> Column:
    """``width`` bytes, big-endian; higher digits are cut off."""
    value = F.lit(value) if isinstance(value, int) else value
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * width, 2 * width))


def bytes_of(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def joined(parts: Column) -> Column:
    """The members of an array of binaries, one behind the other."""
    return F.aggregate(parts, F.lit(b""), lambda all_, part: F.concat(all_, part))


def sized(content: Column, width: int) -> Column:
    """``content`` behind its length."""
    return bound(content, lambda c: F.concat(uint(F.length(c), width), c))


def numbers(values: Column, width: int) -> Column:
    return joined(F.transform(values, lambda v: uint(v, width)))


# -- frames ---------------------------------------------------------------------
def ipv4_address(text: Column) -> Column:
    return numbers(F.split(text, r"\."), 1)


def ipv4(protocol: Column, source: Column, target: Column, body: Column, ttl: int = 64) -> Column:
    """An IPv4 packet without options (no checksum)."""
    return F.concat(uint(0x45, 1), uint(0, 1), uint(F.length(body) + 20, 2), uint(0, 4), uint(ttl, 1), uint(protocol, 1), uint(0, 2),
                    ipv4_address(source), ipv4_address(target), body)


def tcp(source: Column, target: Column, seq: Column, flags: Column, payload: Column) -> Column:
    return F.concat(uint(source, 2), uint(target, 2), uint(seq, 4), uint(0, 4), uint(0x50, 1), uint(flags, 1), uint(1024, 2), uint(0, 4), payload)


def udp(source: Column, target: Column, payload: Column) -> Column:
    return F.concat(uint(source, 2), uint(target, 2), uint(F.length(payload) + 8, 2), uint(0, 2), payload)


def ethernet(kind: int, body: Column, vlan: Column | None = None) -> Column:
    """A frame; ``vlan`` is the number of a tag, or null for a frame without one."""
    tag = F.lit(b"") if vlan is None else F.coalesce(F.concat(uint(0x8100, 2), uint(vlan, 2)), F.lit(b""))
    return F.concat(F.lit(bytes(12)), tag, uint(kind, 2), body)


# -- messages -------------------------------------------------------------------
def dns_name(name: Column) -> Column:
    return F.concat(joined(F.transform(F.split(name, r"\."), lambda label: sized(bytes_of(label), 1))), uint(0, 1))


def dns_message(txid: Column, response: Column, rcode: Column, name: Column, qtype: Column, qclass: Column, records: Column | None = None,
                record_count: Column | None = None) -> Column:
    """A message with one question; ``records`` are written behind it as they are."""
    flags = F.when(response, F.lit(0x8180)).otherwise(0x0100) + rcode
    return F.concat(uint(txid, 2), uint(flags, 2), uint(1, 2), uint(record_count if record_count is not None else 0, 2), uint(0, 4), dns_name(name),
                    uint(qtype, 2), uint(qclass, 2), records if records is not None else F.lit(b""))


def dns_address_record(address: Column, offset: int = 12) -> Column:
    """An address record whose owner points back to the question."""
    return F.concat(uint(0xC000 + offset, 2), uint(1, 2), uint(1, 2), uint(60, 4), sized(ipv4_address(address), 2))


def tls_extension(number: Column | int, content: Column) -> Column:
    return F.concat(uint(number, 2), sized(content, 2))


def tls_hello(kind: Column, version: Column, ciphers: Column, extensions: Column) -> Column:
    """The handshake of a client (kind 1) or server (2, first cipher only) hello; ``extensions`` are encoded ones."""
    offer = F.when(kind == 1, F.concat(sized(numbers(ciphers, 2), 2), sized(uint(0, 1), 1))).otherwise(F.concat(uint(F.get(ciphers, F.lit(0)), 2), uint(0, 1)))
    body = F.concat(uint(version, 2), F.lit(bytes(32)), uint(0, 1), offer, sized(extensions, 2))
    return F.concat(uint(kind, 1), sized(body, 3))


def tls_records(handshake: Column, size: int) -> Column:
    """``handshake`` in records of ``size`` bytes."""
    def cut(whole: Column) -> Column:
        count = F.ceil(F.length(whole) / F.lit(size)).cast("int")
        part = lambda i: F.substring(whole, (i * size + 1).cast("int"), F.lit(size))
        return joined(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(uint(0x16, 1), uint(0x0301, 2), sized(part(i), 2))))

    return bound(handshake, cut)


def varint(value: Column) -> Column:
    """The shortest QUIC number."""
    return (F.when(value < 1 << 6, uint(value, 1)).when(value < 1 << 14, uint(value + (1 << 14), 2))
             .when(value < 1 << 30, uint(value + (1 << 31), 4)).otherwise(uint(value - (1 << 62), 8)))


def quic_packet(kind: Column, version: Column, destination: Column, source: Column, token: Column, payload: Column) -> Column:
    """A long header packet: kind 0 initial, 1 early data, 2 handshake, 3 retry (the token and sixteen bytes); version 0 lists ``payload`` as versions."""
    head = F.concat(uint(F.lit(0xC0) + kind % 4 * 16, 1), uint(version, 4), sized(destination, 1), sized(source, 1))
    numbered = F.concat(varint(F.length(payload)), payload)
    return F.when(version == 0, F.concat(head, payload)).when(kind == 3, F.concat(head, token, F.lit(bytes(16)))).otherwise(
        F.concat(head, F.when(kind == 0, F.concat(varint(F.length(token)), token)).otherwise(F.lit(b"")), numbered))
