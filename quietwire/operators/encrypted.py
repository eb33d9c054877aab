"""TLS and QUIC metadata evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions.keys import has_flag
from quietwire.operators.clock import as_of, tick, with_carry
from quietwire.operators.flows import flow_packets
from quietwire.schema import EncryptedParams, FlowParams

# Order in which direction statuses decide the status of a connection.
STATUS_ORDER = ("COMPLETE", "MALFORMED", "TRUNCATED", "ENCRYPTED_APPLICATION_DATA", "UNSUPPORTED", "INCOMPLETE")
ECH_EXTENSION = 65037


# -- hellos -----------------------------------------------------------------
def without_grease(values: Column) -> Column:
    """H4: numbers joined by dashes, reserved filler values left out."""
    grease = F.array(*[F.lit(g) for g in S.TLS_GREASE])
    kept = F.filter(values, lambda x: ~F.array_contains(grease, x.cast("int")))
    return F.array_join(F.transform(kept, lambda x: x.cast("string")), "-")


def fingerprints(hellos: DataFrame) -> DataFrame:
    """Adds fingerprint family, canonical text and digest, and the selected version."""
    server = F.col("handshake_type") == 2
    base = [F.col("legacy_version").cast("string"), without_grease(F.col("ciphers")), without_grease(F.col("extensions"))]
    points = F.array_join(F.transform("point_formats", lambda x: x.cast("string")), "-")
    client_text = F.concat_ws(",", *base, without_grease(F.col("groups")), points)
    canonical = F.when(server, F.concat_ws(",", *base)).otherwise(client_text)
    chosen = F.coalesce(F.try_element_at("supported_versions", F.lit(1)), F.col("legacy_version"))
    return hellos.withColumn("canonical", canonical).withColumns({
        "family": F.when(server, "JA3S").otherwise("JA3"), "digest": F.md5("canonical"),
        "selected_version": F.when(server, chosen)})


def name_visibility(sni: Column, extensions: Column) -> Column:
    """What the visible server name tells; an ECH extension hides the inner one."""
    ech = F.array_contains(extensions, ECH_EXTENSION)
    return (F.when(ech & sni.isNotNull(), "outer_name_only_ech_extension_observed")
             .when(ech, "unavailable_ech_extension_observed")
             .when(sni.isNotNull(), "plaintext_observed").otherwise("not_observed"))


def _observed(kind: str, value: Column, unit: str, when: Column, detector: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("signal_type"), F.lit(detector).alias("detector"),
                                 value.cast("double").alias("observed_value"), F.lit(unit).alias("unit"),
                                 F.lit("observed").alias("comparison")))


def hello_signals(hellos: DataFrame, *keys: str) -> DataFrame:
    """The signal rows of every complete hello."""
    yes, one = F.lit(True), F.lit(1)
    client = F.col("handshake_type") == 1
    has = set(hellos.columns)
    rules = [
        _observed("TLS_CLIENT_HELLO_OBSERVED", one, "hello", client, "tls_metadata"),
        _observed("TLS_SERVER_HELLO_OBSERVED", one, "hello", ~client, "tls_metadata"),
        _observed("TLS_VERSION_CONTEXT", F.col("legacy_version"), "wire legacy version", yes, "tls_metadata"),
        _observed("TLS_CIPHER_PROFILE", F.size("ciphers"), "observed cipher suites", yes, "tls_metadata"),
        _observed("TLS_EXTENSION_PROFILE", F.size("extensions"), "observed extensions", yes, "tls_metadata"),
        _observed("TLS_FINGERPRINT", one, "metadata identifier", yes, "tls_metadata")]
    if "sni" in has:
        rules.append(_observed("TLS_SNI_CONTEXT", one, "visible name", F.col("sni").isNotNull(), "tls_metadata"))
    if "alpn" in has:
        rules.append(_observed("TLS_ALPN_CONTEXT", F.size("alpn"), "visible protocol identifiers", F.size("alpn") > 0, "tls_metadata"))
    return hellos.withColumn("rules", F.array_compact(F.array(*rules))).select(*keys, F.inline("rules"))


def tls_status(directions: DataFrame, key: str) -> DataFrame:
    """Status and visibility of a connection from its directions (status, role)."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    best = F.min(F.when(place > 0, place))
    roles = F.array_sort(F.collect_set(F.when(F.col("status") == "COMPLETE", F.col("role"))))  # at most two values
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return directions.groupBy(key).agg(best.alias("best"), roles.alias("roles")).select(
        key, F.coalesce(F.try_element_at(names, F.col("best").cast("int")), F.lit("UNAVAILABLE")).alias("tls_status"),
        F.when(F.size("roles") == 2, "BOTH").when(F.size("roles") == 1, F.concat(F.col("roles")[0], F.lit("_ONLY")))
         .otherwise("INCOMPLETE").alias("visibility"))


# -- connections -------------------------------------------------------------
def connection_packets(packets: DataFrame, p: EncryptedParams = EncryptedParams(), in_order: bool = False) -> DataFrame:
    """Packets with the first arrival number of their connection (``conn_seq``).

    Silence beyond ``ttl_sec`` starts a connection, and so does a SYN that does not
    repeat the previous one (same direction and sequence number, no FIN, RST or
    silence in between).  Silences and FIN/RST counts come from the flow cutter.
    """
    beyond = p.ttl_sec + 1e-6  # silence is strictly longer than the time to live
    rows = flow_packets(packets, FlowParams(idle_sec=beyond, fin_grace_sec=0.0), in_order)
    seq = F.col("tcp_seq") if "tcp_seq" in packets.columns else F.lit(0)
    rows = rows.withColumn("syn_of", F.when(
        (F.col("protocol") == 6) & has_flag(S.TCP_SYN) & ~has_flag(S.TCP_ACK),
        F.concat_ws(":", F.col("lo_to_hi").cast("string"), F.coalesce(seq, F.lit(0)).cast("string"))))
    group = ["direction_key", "epoch", "rst_no"]
    syns = rows.filter("syn_of is not null").select(*group, "tile", "pkt_seq", "syn_of")
    last = syns.groupBy(*group, "tile").agg(F.max_by("syn_of", "pkt_seq").alias("tail"))
    carry = last.withColumn("carried", F.lag("tail").over(Window.partitionBy(*group).orderBy("tile"))).drop("tail")
    local = Window.partitionBy(*group, "tile").orderBy("pkt_seq")
    seen = F.coalesce(F.lag("syn_of").over(local), F.col("carried"))
    restarts = (syns.join(carry, [*group, "tile"]).withColumn("repeat", F.coalesce(seen == F.col("syn_of"), F.lit(False)))
                .filter("not repeat").select("direction_key", "tile", "pkt_seq", F.col("pkt_seq").alias("restart")))
    rows = rows.join(restarts, ["direction_key", "tile", "pkt_seq"], "left")
    key = ["direction_key", "epoch"]
    per_tile = rows.groupBy(*key, "tile").agg(F.max("restart").alias("top"), F.min("pkt_seq").alias("first"))
    before = with_carry(per_tile, key, "tile", {"restart_before": F.max("top"), "first_before": F.min("first")})
    before = before.withColumn("base", F.coalesce("restart_before", "first_before", "first")).select(*key, "tile", "base")
    through = (Window.partitionBy(*key, "tile").orderBy("pkt_seq")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(before, [*key, "tile"])
            .withColumn("conn_seq", F.coalesce(F.max("restart").over(through), F.col("base"))).drop("restart", "base", "syn_of"))


CONNECTION = ["direction_key", "conn_seq"]


def connection_timing(rows: DataFrame, width: float = EncryptedParams().ttl_sec) -> DataFrame:
    """Size and gap statistics of all packets of every connection.

    Gaps are formed inside slices of ``width`` seconds; the gap between two slices
    joins their ends, so no connection is ever ordered or gathered whole.
    """
    size, key = F.col("ip_total_length"), [*CONNECTION, "slice"]
    sliced = rows.withColumn("slice", tick(F.col("ts"), width))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(*key).orderBy("ts", "pkt_seq"))
    ends = sliced.groupBy(*key).agg(F.min("ts").alias("head"), F.max("ts").alias("tail"))
    border = ends.select(*CONNECTION, (F.col("head") - F.lag("tail").over(Window.partitionBy(*CONNECTION).orderBy("slice"))).alias("gap")).filter("gap is not null")
    fed = sliced.withColumn("gap", gap).select(*CONNECTION, "ts", "gap", "lo_to_hi", size.alias("size")).unionByName(border, allowMissingColumns=True)
    both = F.bool_or("lo_to_hi").cast("int") + F.bool_or(~F.col("lo_to_hi")).cast("int")
    return fed.groupBy(*CONNECTION).agg(
        F.count("size").alias("packets"), F.min("ts").alias("started"), F.max("ts").alias("last"), F.min("size").alias("packet_size_min"),
        F.max("size").alias("packet_size_max"), F.avg("size").alias("packet_size_mean"), F.avg("gap").alias("gap_mean"), F.min("gap").alias("gap_min"),
        F.max("gap").alias("gap_max"), both.cast("long").alias("direction_count")).withColumn("sample_count", F.col("packets"))


def contained(flow: DataFrame, connections: DataFrame, width: float) -> DataFrame:
    """Flows with the newest connection of their conversation that lies inside them.

    That is the last one that ended up to the flow's end, if it does not start before the flow: the connections of a conversation follow one another.
    """
    value = F.struct("conn_seq", "started", "last", "packets")
    found = as_of(flow.select("flow_id", "direction_key", "start_time", "end_time"), connections, ["direction_key"], "end_time", "last", "conn_seq", value, width, "c")
    return found.filter(F.col("c.started") >= F.col("start_time")).select("flow_id", "c.*")


# -- QUIC -----------------------------------------------------------------------
def latest_headers(headers: DataFrame, *keys: str) -> DataFrame:
    """The newest header per key; a short header never displaces a long one."""
    long = F.coalesce("long_header", F.lit(False))
    names = [c for c in headers.columns if c not in keys]
    best = F.max_by(F.struct(*names), F.struct(long, "ts", "pkt_seq"))
    return headers.groupBy(*keys).agg(best.alias("h"), F.max("ts").alias("last_packet_ts")).select(*keys, "h.*", "last_packet_ts")


def quic_status(latest: DataFrame, key: str, direction: str) -> DataFrame:
    """COMPLETE if any direction is, else the status of the last direction."""
    return latest.groupBy(key).agg(
        F.when(F.bool_or(F.col("status") == "COMPLETE"), "COMPLETE").otherwise(F.max_by("status", direction)).alias("quic_status"),
        F.when(F.count_distinct(direction) == 2, "BOTH_DIRECTIONS_OBSERVED").otherwise("ONE_DIRECTION_OBSERVED").alias("visibility"))


def header_signals(headers: DataFrame, *keys: str) -> DataFrame:
    """The signal rows of every long header."""
    yes = F.lit(True)
    rules = F.array_compact(F.array(
        _observed("QUIC_LONG_HEADER_OBSERVED", F.lit(1), "visible header", yes, "quic_metadata"),
        _observed("QUIC_VERSION_CONTEXT", F.col("version"), "wire version", yes, "quic_metadata"),
        _observed("QUIC_CONNECTION_ID_CONTEXT", F.col("destination_cid_length"), "CID bytes", yes, "quic_metadata"),
        _observed("QUIC_VERSION_NEGOTIATION", F.size("supported_versions"), "advertised versions", F.col("version") == 0, "quic_metadata")))
    return headers.filter("long_header").withColumn("rules", rules).select(*keys, F.inline("rules"))


def timing_signals(timing: DataFrame, seen: DataFrame, family: str) -> DataFrame:
    """Packet timing of connections whose protocol was recognised (``seen`` keys)."""
    kind = {"tls": "ENCRYPTED_SESSION_PACKET_TIMING", "quic": "QUIC_PACKET_SIZE_PATTERN"}[family]
    return timing.join(seen.select(*CONNECTION).distinct(), CONNECTION, "left_semi").select(
        *CONNECTION, F.lit(kind).alias("signal_type"), F.lit("encrypted_session_behavior").alias("detector"),
        F.col("sample_count").cast("double").alias("observed_value"))
