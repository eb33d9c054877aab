"""Thresholded window values as signal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.schema import WindowParams


def signal(kind: str, detector: str, value: Column, threshold: float, unit: str, when: Column,
           context: dict[str, Column], comparison: str = ">=") -> Column:
    """A signal struct, or null where the rule does not hold."""
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return F.when(when, F.struct(
        F.lit(kind).alias("signal_type"), F.lit(detector).alias("detector"),
        value.cast("double").alias("observed_value"), F.lit(float(threshold)).alias("threshold"),
        F.lit(unit).alias("unit"), F.lit(comparison).alias("comparison"),
        F.create_map(*pairs).alias("context")))


def behaviour_signals(windows: DataFrame, p: WindowParams) -> DataFrame:
    """One row per rule that holds for a flow."""
    c = F.col
    seconds = F.lit(float(p.window_sec))
    rules = []
    for kind, counter, limit in (
            ("SYN_RATE", "syn", p.syn_rate), ("UDP_RATE", "udp", p.udp_rate),
            ("UDP_FLOW_RATE", "udp_flows", p.udp_flow_rate), ("FLOW_RATE", "flows", p.flow_rate),
            ("DESTINATION_PACKET_RATE", "packets", p.packet_rate)):
        rate = c(counter) / seconds
        rules.append(signal(kind, "stream_ddos", rate, limit, "observations/s", rate >= limit,
                            {"observations": c(counter)}))
    enough = c("sessions") >= p.min_sessions
    focused = c("concentration") >= p.concentration_ratio
    rules += [
        signal("UNIQUE_SOURCE_COUNT", "stream_ddos", c("source_distinct"), p.unique_sources, "sources",
               c("source_distinct") >= p.unique_sources, {"observations": c("packets")}),
        signal("SOURCE_DISTRIBUTION_ENTROPY", "stream_ddos", c("source_entropy"), p.entropy_bits, "bits",
               (c("packets") >= p.min_entropy_observations) & (c("source_entropy") >= p.entropy_bits),
               {"observations": c("packets"), "unique_sources": c("source_distinct")}),
        signal("DESTINATION_CONCENTRATION", "stream_c2", c("concentration"), p.concentration_ratio,
               "fraction of observed sessions", enough & focused,
               {"sessions": c("sessions"), "distinct_destinations": c("host_distinct")}),
        signal("C2_PERIODICITY_EVIDENCE", "stream_c2", c("gap_cv"), p.periodicity_cv,
               "coefficient of variation",
               (c("n_times") >= p.min_sessions) & (c("gap_cv") <= p.periodicity_cv) & focused,
               {"sessions": c("n_times"), "interval_mean_sec": c("gap_mean"),
                "interval_stddev_sec": c("gap_std")}, "<="),
        signal("PORT_FANOUT", "stream_recon", c("port_distinct"), p.port_fanout,
               "distinct observed values", c("port_distinct") >= p.port_fanout,
               {"sessions": c("sessions")}),
        signal("HOST_FANOUT", "stream_recon", c("host_distinct"), p.host_fanout,
               "distinct observed values", c("host_distinct") >= p.host_fanout,
               {"sessions": c("sessions")}),
    ]
    for way, dominant, opposing, heavy in (
            ("initiator_to_responder", "fwd_bytes", "rev_bytes", "heavy_forward"),
            ("responder_to_initiator", "rev_bytes", "fwd_bytes", "heavy_reverse")):
        ratio = c(dominant).cast("double") / F.greatest(c(opposing), F.lit(1))
        rules.append(signal(
            "DIRECTIONAL_ASYMMETRY", "stream_asymmetry", ratio, p.directional_ratio,
            "bytes / max(opposing bytes, 1)",
            (c(dominant) >= p.directional_bytes) & (ratio >= p.directional_ratio)
            & (c(heavy) >= p.min_directional_flows),
            {"direction": F.lit(way), "directional_flows": c(heavy)}))
    return (windows.withColumn("rules", F.array_compact(F.array(*rules)))
            .select("flow_id", "direction_key", "first_seq", "eval_tick", "window_start", "window_end",
                    F.inline("rules")))


def policy(signals: DataFrame, flow: DataFrame, p: WindowParams) -> DataFrame:
    """The disposition of every flow given the signals it carries."""
    counts = signals.groupBy("flow_id").agg(F.count("*").alias("signals"))
    n = F.coalesce("signals", F.lit(0))
    action = F.when(n > 0, p.policy_mode).otherwise("informational")
    return flow.select("flow_id").join(counts, "flow_id", "left").select(
        "flow_id", n.alias("signals"), action.alias("action"),
        ((n > 0) & (action == "behavioral_alert")).alias("behavioral_alert"))


def technique_context(signals: DataFrame) -> DataFrame:
    """Techniques a detector may cite as context, once per flow and detector."""
    spark = signals.sparkSession
    allowed = spark.createDataFrame(list(S.DETECTOR_TECHNIQUES),
                                    "detector string, threat_type string, technique_id string")
    names = spark.createDataFrame(list(S.TECHNIQUES), S.TECHNIQUE_SCHEMA)
    table = allowed.join(names, ["threat_type", "technique_id"])
    return (signals.select("flow_id", "detector").distinct().join(F.broadcast(table), "detector")
            .select("flow_id", "detector", "technique_id", "technique_name", "tactic", "applicability"))


def signal_counts(signals: DataFrame) -> DataFrame:
    """Occurrences per detector and signal type."""
    return signals.groupBy("detector", "signal_type").agg(
        F.count("*").alias("occurrences"), F.count_distinct("flow_id").alias("flows"))
