"""Frames and messages written from table columns and read back by the decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.operators import encrypted as T
from quietwire.plans import bindings as B
from quietwire.plans.registry import query
from quietwire.sources import capture as C
from quietwire.sources import encode as E
from quietwire.sources import messages as M

V = B.SQL_VIEWS


def frames(spark, sf):
    """Every packet as an Ethernet frame, one of seven with a VLAN tag, and an ARP frame after every eleventh packet."""
    p = B.packets(spark, sf)
    payload = F.encode(F.repeat(F.lit("x"), F.col("payload_size")), "UTF-8")
    body = F.when(F.col("protocol") == 6, E.tcp(F.col("src_port"), F.col("dst_port"), F.col("pkt_seq") % (1 << 32), F.col("tcp_flags"), payload)).otherwise(
        E.udp(F.col("src_port"), F.col("dst_port"), payload))
    raw = E.ethernet(0x0800, E.ipv4(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"), body), F.when(F.col("pkt_seq") % 7 == 0, F.col("pkt_seq") % 4096))
    arp = p.filter("pkt_seq % 11 = 0").select(F.col("pkt_seq"), "ts", E.ethernet(0x0806, F.lit(bytes(28))).alias("raw"))
    return p.select("pkt_seq", "ts", raw.alias("raw")).unionByName(arp)


@query("decoded_packets", B.with_views("""
select pkt_seq, ts, src_ip, dst_ip, src_port, dst_port, protocol, 64 as ttl, payload_size + case when protocol=6 then 40 else 28 end as ip_total_length, payload_size,
 tcp_flags, case when protocol=6 then pkt_seq % 4294967296 end as tcp_seq, false as fragment from packets""", "packets"))
def decoded_packets(spark, sf):
    """The packets, written as frames and decoded again."""
    return C.decode(frames(spark, sf)).select("pkt_seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", "ip_total_length", "payload_size",
                                              "tcp_flags", "tcp_seq", "fragment")


@query("parse_accounting", B.with_views("""
select n + arp as packet_count, n as parsed_count, arp as skipped_count, arp as non_ip_count from (select count(*) as n, count(*) filter (pkt_seq % 11 = 0) as arp from packets)""", "packets"))
def parse_accounting(spark, sf):
    """A4, A5: frames read, parsed and skipped."""
    from quietwire.operators.clock import with_scalars

    raw = frames(spark, sf)
    return with_scalars(C.parse_counts(raw, C.decode(raw)), C.non_ip(raw).agg(F.count("*").alias("non_ip_count")))


# -- DNS ------------------------------------------------------------------------
V["dns_wire"] = (("dns",), """
select *, pid % 2 = 1 as framed, pid % 17 = 0 as hidden, pid % 13 = 0 as cut from (select *, transaction_id as pid from dns)
where regexp_full_match(qname, '[a-z0-9_-]+([.][a-z0-9_-]+)*')""")


def dns_packets(spark, sf):
    """The DNS messages as payloads: odd ones over TCP (every ninth twice in a segment), some cut by a byte, some on the encrypted port."""
    d = B.dns(spark, sf).filter(F.col("qname").rlike("^[a-z0-9_-]+([.][a-z0-9_-]+)*$")).withColumn("pid", F.col("transaction_id"))
    answers = F.col("qr") & (F.col("rcode") == 0)
    records = F.when(answers, E.dns_address_record(F.col("src_ip"))).otherwise(F.lit(b""))
    message = E.dns_message(F.col("pid") % 65536, F.col("qr"), F.col("rcode"), F.col("qname"), F.col("qtype"), F.lit(1), records, answers.cast("int"))
    cut = F.when(F.col("pid") % 13 == 0, F.substring(F.col("m"), F.lit(1), F.length("m") - 1)).otherwise(F.col("m"))
    framed = E.sized(F.col("m"), 2)
    payload = F.when(F.col("pid") % 2 == 0, F.col("m")).when(F.col("pid") % 9 == 0, F.concat(framed, framed)).otherwise(framed)
    port = lambda c: F.when((F.col(c) == 53) & (F.col("pid") % 17 == 0), 853).otherwise(F.col(c)).alias(c)
    return d.withColumn("m", message).withColumn("m", cut).select(
        "pkt_seq", "ts", "src_ip", "dst_ip", port("src_port"), port("dst_port"), F.when(F.col("pid") % 2 == 0, 17).otherwise(6).alias("protocol"),
        F.lit(False).alias("fragment"), payload.alias("payload"))


@query("decoded_dns", B.with_views("""
select pkt_seq, case when framed then 6 else 17 end as protocol, case when hidden then 'ENCRYPTED_OR_UNAVAILABLE' when cut then 'TRUNCATED' else 'PARSED' end as status,
 case when not hidden and not cut then transaction_id % 65536 end as transaction_id, case when not hidden and not cut then qr end as qr,
 case when not hidden and not cut then rcode end as rcode, case when not hidden and not cut then qname end as qname,
 case when not hidden and not cut then qtype end as qtype
from (select *, unnest(case when framed and not hidden and pid % 9 = 0 then [1, 2] else [1] end) as time from dns_wire)""", "dns_wire"))
def decoded_dns(spark, sf):
    """Messages written as bytes, decoded over UDP and length-prefixed over TCP."""
    found = M.dns_messages(dns_packets(spark, sf))
    q = F.get("questions", F.lit(0))
    return found.select("pkt_seq", "protocol", "status", "transaction_id", "qr", "rcode", q["name"].alias("qname"), q["qtype"].alias("qtype"))


# -- TLS ------------------------------------------------------------------------
V["wire_hellos"] = (("hellos",), """
select hello_id, handshake_type, legacy_version, ['INCOMPLETE', 'MALFORMED', 'COMPLETE'][case when hello_id % 50 = 9 then 1 when hello_id % 50 = 7 then 2 else 3 end] as status,
 case when handshake_type = 1 then list_transform(ciphers, lambda c: c % 65536) else [ciphers[1] % 65536] end as ciphers,
 list_concat(case when sni is null then [] else [0] end, [10, 11], case when len(alpn) = 0 then [] else [16] end, case when len(supported_versions) = 0 then [] else [43] end,
  list_transform(extensions, lambda e: 100 + e % 60000)) as extensions, groups, supported_versions, sni, alpn
from (select *, case when handshake_type = 1 and hello_id % 3 = 0 then 'host-' || hello_id || '.example.test' end as sni,
 case when hello_id % 5 <> 0 then []::varchar[] when handshake_type = 1 then ['h2', 'http/1.1'] else ['h2'] end as alpn from hellos)""")


def hello_segments(spark, sf):
    """The hellos as TLS records of 50 bytes, cut into three overlapping segments that arrive in any order around the wrap of sequence numbers.

    One of fifty contradicts itself, one lacks its end.
    """
    h, key = B.hellos(spark, sf), F.col("hello_id")
    client = F.col("handshake_type") == 1
    name = F.concat(F.lit("Host-"), key.cast("string"), F.lit(".example.test"))
    spoken = F.when(client, F.array(F.lit("h2"), F.lit("http/1.1"))).otherwise(F.array(F.lit("h2")))
    none = F.lit(b"")
    versions = E.numbers(F.col("supported_versions"), 2)
    extensions = F.concat(
        F.when(client & (key % 3 == 0), E.tls_extension(0, E.sized(F.concat(E.uint(0, 1), E.sized(E.bytes_of(name), 2)), 2))).otherwise(none),
        E.tls_extension(10, E.sized(E.numbers(F.col("groups"), 2), 2)), E.tls_extension(11, E.sized(E.uint(0, 1), 1)),
        F.when(key % 5 == 0, E.tls_extension(16, E.sized(E.joined(F.transform(spoken, lambda a: E.sized(E.bytes_of(a), 1))), 2))).otherwise(none),
        F.when(F.size("supported_versions") == 0, none).when(client, E.tls_extension(43, E.sized(versions, 1))).otherwise(E.tls_extension(43, versions)),
        E.joined(F.transform("extensions", lambda e: E.tls_extension(100 + e % 60000, none))))
    stream = E.tls_records(E.tls_hello(F.col("handshake_type"), F.col("legacy_version"), F.col("ciphers"), extensions), 50)
    whole = F.lit(1 << 30)
    part = lambda first, size: F.substring("stream", F.lit(first + 1), size)
    second = F.when(key % 50 == 7, F.concat(F.lit(b"\xff" * 5), part(25, F.lit(45)))).otherwise(part(20, F.lit(50)))
    segment = lambda nth, at, data: F.struct(F.lit(nth).alias("nth"), F.lit(at).alias("at"), data.alias("payload"))
    cuts = F.array(segment(0, 0, part(0, F.lit(30))), segment(1, 20, second), segment(2, 70, part(70, whole)))
    order = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))]), (key % 6 + 1).cast("int"))
    rows = h.withColumn("stream", stream).withColumn("order", order).withColumn("s", F.explode(cuts)).filter("not (hello_id % 50 = 9 and s.nth = 2)")
    arrival = key * 10 + F.element_at("order", F.col("s.nth") + 1)
    return rows.select(
        key.cast("string").alias("direction_key"), F.lit(0).cast("long").alias("conn_seq"), F.lit(True).alias("lo_to_hi"), arrival.alias("pkt_seq"),
        arrival.cast("double").alias("ts"), F.lit(6).alias("protocol"), F.lit(40000).alias("src_port"), F.lit(443).alias("dst_port"), F.lit(24).alias("tcp_flags"),
        ((F.lit((1 << 32) - 60) + key % 50 + F.col("s.at")) % (1 << 32)).alias("tcp_seq"), F.col("s.payload").alias("payload"))


def wire_hellos(spark, sf):
    return B.stored(spark, sf, "wire_hellos", lambda: M.tls_hellos(hello_segments(spark, sf)).withColumn("hello_id", F.col("direction_key").cast("long")))


def _text(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("decoded_hellos", B.with_views("""
select hello_id, status, case when ok then handshake_type end as handshake_type, case when ok then legacy_version end as legacy_version,
 case when ok then array_to_string(ciphers, ',') end as ciphers, case when ok then array_to_string(extensions, ',') end as extensions,
 case when ok then array_to_string(groups, ',') end as groups, case when ok then '0' end as point_formats,
 case when ok then array_to_string(supported_versions, ',') end as supported_versions, case when ok then sni end as sni, case when ok then array_to_string(alpn, ',') end as alpn
from (select *, status = 'COMPLETE' as ok from wire_hellos)""", "wire_hellos"))
def decoded_hellos(spark, sf):
    """Hellos from permuted, overlapping segments whose sequence numbers wrap."""
    return wire_hellos(spark, sf).select("hello_id", "status", "handshake_type", "legacy_version", *map(_text, ("ciphers", "extensions", "groups", "point_formats",
                                         "supported_versions")), "sni", _text("alpn"))


@query("decoded_hello_signals", B.with_views("""
select signal_type, count(*) as hellos, round(sum(v),2)+0.0 as total from (
 select case when handshake_type=1 then 'TLS_CLIENT_HELLO_OBSERVED' else 'TLS_SERVER_HELLO_OBSERVED' end as signal_type, 1 as v from done
 union all select 'TLS_VERSION_CONTEXT', legacy_version from done union all select 'TLS_CIPHER_PROFILE', len(ciphers) from done
 union all select 'TLS_EXTENSION_PROFILE', len(extensions) from done union all select 'TLS_FINGERPRINT', 1 from done
 union all select 'TLS_SNI_CONTEXT', 1 from done where sni is not null union all select 'TLS_ALPN_CONTEXT', len(alpn) from done where len(alpn) > 0) group by all""".replace(
    "from done", "from (select * from wire_hellos where status = 'COMPLETE')"), "wire_hellos"))
def decoded_hello_signals(spark, sf):
    """Signals of the decoded hellos, server name and protocol rows included."""
    complete = wire_hellos(spark, sf).filter("status = 'COMPLETE'")
    return T.hello_signals(complete, "hello_id").groupBy("signal_type").agg(F.count("*").alias("hellos"), F.round(F.sum("observed_value"), 2).alias("total"))


@query("hello_name_visibility", B.with_views("""
select case when sni is not null then 'plaintext_observed' else 'not_observed' end as visibility, count(*) as hellos from wire_hellos where status = 'COMPLETE' group by all""",
                                             "wire_hellos"))
def hello_name_visibility(spark, sf):
    """What the decoded hellos show of the server's name."""
    complete = wire_hellos(spark, sf).filter("status = 'COMPLETE'")
    return complete.groupBy(T.name_visibility(F.col("sni"), F.col("extensions")).alias("visibility")).agg(F.count("*").alias("hellos"))


# -- QUIC -----------------------------------------------------------------------
V["quic"] = ((), """
select *, case when kind = 5 then 'UNSUPPORTED' when version not in (0, 1) then 'UNSUPPORTED' when cut then 'TRUNCATED' else 'COMPLETE' end as status,
 kind <> 5 and (not cut or version not in (0, 1)) as known from (
 select page_id::bigint as pkt_seq, page_id::double as ts, '10.0.2.'||(page_id % 50)||':'||(40000 + page_id % 50)||'-192.0.2.9:443-17' as direction_key, page_id % 2 = 0 as lo_to_hi,
  page_id % 6 as kind, case when page_id % 6 = 4 then 0 when page_id % 10 = 3 then 7 else 1 end as version, page_id % 15 + 1 as dlen, page_id % 5 as slen,
  page_id % 100 as tlen, page_id % 14 = 1 and page_id % 6 in (0, 1, 2) as cut, md5(page_id::varchar) as h from pages)""")
V["quic_headers"] = (("quic",), """
select pkt_seq, ts, direction_key, lo_to_hi, status, case when known then true when kind = 5 then false end as long_header, case when known then version end as version,
 case when known then case when version = 0 then 'VERSION_NEGOTIATION' when version = 7 then 'UNKNOWN_VERSION' else (['INITIAL','ZERO_RTT','HANDSHAKE','RETRY'])[kind+1] end end as packet_type,
 case when known then dlen end as destination_cid_length, case when known then sha256(unhex(substr(h, 1, 2*dlen))) end as destination_cid_sha256,
 case when known then slen end as source_cid_length, case when known and slen > 0 then sha256(unhex(substr(h, 1, 2*slen))) end as source_cid_sha256,
 case when known and version = 0 then '1,7' end as supported_versions, case when known and version = 1 and kind in (0, 3) then tlen end as token_length from quic""")


def quic_packets(spark, sf):
    """Datagrams of ``pages``: every packet type, version lists, unknown versions, short headers, some cut by a byte."""
    p = B.table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("i"))
    i = F.col("i")
    kind, digest = i % 6, F.unhex(F.md5(i.cast("string")))
    version = F.when(kind == 4, 0).when(i % 10 == 3, 7).otherwise(1)
    cid = lambda size: F.substring(digest, F.lit(1), size.cast("int"))
    filler = lambda size: F.encode(F.repeat(F.lit("q"), size.cast("int")), "UTF-8")
    payload = F.when(version == 0, F.concat(E.uint(1, 4), E.uint(7, 4))).otherwise(filler(i % 300 + 1))
    packet = E.quic_packet(kind, version, cid(i % 15 + 1), cid(i % 5), filler(i % 100), payload)
    packet = F.when(kind == 5, F.concat(E.uint(0x40, 1), filler(i % 30))).otherwise(packet)
    rows = p.withColumn("packet", packet).withColumn("cut", (i % 14 == 1) & kind.isin(0, 1, 2))
    client, server = F.concat(F.lit("10.0.2."), (i % 50).cast("string")), F.lit("192.0.2.9")
    ahead = i % 2 == 0
    return rows.select(
        i.alias("pkt_seq"), i.cast("double").alias("ts"), F.when(ahead, client).otherwise(server).alias("src_ip"), F.when(ahead, server).otherwise(client).alias("dst_ip"),
        F.when(ahead, F.lit(40000) + i % 50).otherwise(443).cast("int").alias("src_port"), F.when(ahead, 443).otherwise(F.lit(40000) + i % 50).cast("int").alias("dst_port"),
        F.lit(17).alias("protocol"), F.when(F.col("cut"), F.substring("packet", F.lit(1), F.length("packet") - 1)).otherwise(F.col("packet")).alias("payload"))


@query("quic_header_fields", B.with_views("select * from quic_headers", "quic_headers"))
def quic_header_fields(spark, sf):
    """B32."""
    return M.quic_headers(quic_packets(spark, sf)).withColumn("supported_versions", F.array_join(F.col("supported_versions").cast("array<string>"), ","))


V["quic_latest"] = (("quic_headers",), """
select *, max(ts) over (partition by direction_key, lo_to_hi) as last_packet_ts from quic_headers
qualify row_number() over (partition by direction_key, lo_to_hi order by coalesce(long_header, false) desc, ts desc, pkt_seq desc) = 1""")


@query("latest_headers", B.with_views("select direction_key, lo_to_hi, pkt_seq, status, packet_type, last_packet_ts from quic_latest", "quic_latest"))
def latest_headers(spark, sf):
    """The newest header of each direction, long ones first."""
    latest = T.latest_headers(M.quic_headers(quic_packets(spark, sf)), "direction_key", "lo_to_hi")
    return latest.select("direction_key", "lo_to_hi", "pkt_seq", "status", "packet_type", "last_packet_ts")


@query("quic_status", B.with_views("""
select direction_key, case when bool_or(status = 'COMPLETE') then 'COMPLETE' else arg_max(status, lo_to_hi) end as quic_status,
 case when count(distinct lo_to_hi) = 2 then 'BOTH_DIRECTIONS_OBSERVED' else 'ONE_DIRECTION_OBSERVED' end as visibility from quic_latest group by all""", "quic_latest"))
def quic_status(spark, sf):
    """B47."""
    latest = T.latest_headers(M.quic_headers(quic_packets(spark, sf)), "direction_key", "lo_to_hi")
    return T.quic_status(latest, "direction_key", "lo_to_hi")


@query("quic_header_signals", B.with_views("""
select signal_type, count(*) as headers, sum(v)::bigint as total from (select 'QUIC_LONG_HEADER_OBSERVED' as signal_type, 1 as v from quic_headers where long_header
 union all select 'QUIC_VERSION_CONTEXT', version from quic_headers where long_header union all select 'QUIC_CONNECTION_ID_CONTEXT', destination_cid_length from quic_headers where long_header
 union all select 'QUIC_VERSION_NEGOTIATION', 2 from quic_headers where long_header and version = 0) group by all""", "quic_headers"))
def quic_header_signals(spark, sf):
    """I25."""
    found = T.header_signals(M.quic_headers(quic_packets(spark, sf)), "pkt_seq")
    return found.groupBy("signal_type").agg(F.count("*").alias("headers"), F.sum("observed_value").cast("long").alias("total"))
