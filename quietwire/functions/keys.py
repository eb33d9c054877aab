"""Conversation keys, orientation and protocol names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietwire import schema as S


def _port(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_port"), F.lit(-1))


def low_to_high() -> Column:
    """True when the packet travels from the smaller endpoint to the larger one."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return (src < dst) | ((src == dst) & (_port("src") <= _port("dst")))


def direction_key(lo_to_hi: Column | None = None) -> Column:
    """B1: same text for both directions, endpoints ordered by (ip text, port)."""
    def end(side: str) -> Column:
        return F.concat(F.col(f"{side}_ip"), F.lit(":"), _port(side).cast("string"))

    lo = low_to_high() if lo_to_hi is None else lo_to_hi
    src, dst = end("src"), end("dst")
    text = F.concat(F.when(lo, src).otherwise(dst), F.lit("-"), F.when(lo, dst).otherwise(src),
                    F.lit("-"), F.col("protocol").cast("string"))
    # never null: joins on the key then add no null test that repeats the whole text expression
    return F.coalesce(text, F.lit(""))


# ip:port-ip:port-protocol; an IPv6 address may hold colons, never a dash
_KEY_TEXT = r"^(.*):(-?\d+)-(.*):(-?\d+)-(\d+)$"


def key_part(key: str, name: str) -> Column:
    """A field of a direction key: ``lo_ip lo_port hi_ip hi_port protocol``."""
    index = ("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol").index(name) + 1
    text = F.regexp_extract(F.col(key), _KEY_TEXT, index)
    if name.endswith("_ip"):
        return text
    return F.nullif(text.cast("int"), F.lit(-1))


def unidirectional_key() -> Column:
    """B2: source to destination text; a missing port prints ``None``."""
    def end(side: str) -> Column:
        port = F.coalesce(F.col(f"{side}_port").cast("string"), F.lit("None"))
        return F.concat(F.col(f"{side}_ip"), F.lit(":"), port)

    return F.concat(end("src"), F.lit("-"), end("dst"), F.lit("-"), F.col("protocol").cast("string"))


def has_flag(bit: int, flags: str = "tcp_flags") -> Column:
    return F.coalesce(F.col(flags).bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def flag_marks(flags: str = "tcp_flags") -> dict[str, Column]:
    """The six flag indicators; SYN with ACK counts as SYN-ACK only."""
    syn, ack = has_flag(S.TCP_SYN, flags), has_flag(S.TCP_ACK, flags)
    return {
        "syn": syn & ~ack,
        "syn_ack": syn & ack,
        "ack": ack,
        "fin": has_flag(S.TCP_FIN, flags),
        "rst": has_flag(S.TCP_RST, flags),
        "psh": has_flag(S.TCP_PSH, flags),
    }


def lookup(table: dict, key: Column, default: Column) -> Column:
    """Small constant lookup that stays inside code generation."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), default)


def protocol_name(protocol: str = "protocol") -> Column:
    """B5."""
    number = F.col(protocol).cast("int")
    return lookup(S.PROTOCOL_NAMES, number, F.concat(F.lit("PROTO_"), number.cast("string")))


def dns_type_name(qtype: Column) -> Column:
    """B23."""
    return lookup(S.DNS_TYPE_NAMES, qtype.cast("int"), F.concat(F.lit("TYPE"), qtype.cast("string")))


def ip_version(ip: str) -> Column:
    """A colon marks IPv6."""
    return F.when(F.col(ip).contains(":"), F.lit(6.0)).otherwise(F.lit(4.0))


def protocol_indicators(protocol: str = "protocol") -> dict[str, Column]:
    p = F.col(protocol)
    return {
        "is_tcp": (p == 6).cast("double"),
        "is_udp": (p == 17).cast("double"),
        "is_icmp": p.isin(1, 58).cast("double"),
    }


def _touches(*ports: int) -> Column:
    either = F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)
    return F.coalesce(either, F.lit(False))


def dns_candidate() -> Column:
    """What a DNS reader can make of a packet, judged by its ports."""
    return (F.when(_touches(53), F.lit("decode"))
             .when(_touches(853), F.lit("ENCRYPTED_OR_UNAVAILABLE"))
             .otherwise(F.lit("none")))


def encrypted_family() -> Column:
    """``tls``, ``quic`` or null."""
    return (F.when((F.col("protocol") == 6) & _touches(443, 8443, 853), F.lit("tls"))
             .when((F.col("protocol") == 17) & _touches(443, 4433, 853), F.lit("quic")))
