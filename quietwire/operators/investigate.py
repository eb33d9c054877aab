"""Investigations: linked events, evidence references, timelines, documents
(A13, B37, C3, F9, G2, G3, I26, I27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.functions.numbers import is_number
from quietwire.operators.events import HORIZON_SEC, MAX_EVENTS, neighbourhoods, ranges

LINK_KEYS = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "source_mode")


def source_identity(prefix: str = "") -> Column:
    """What a linked pair must share: the replay file, or the capture interface."""
    mode = F.col(f"{prefix}source_mode")
    return F.when(mode == "REPLAY", F.col(f"{prefix}replay_file_identifier")).otherwise(
        F.col(f"{prefix}capture_interface"))


def linked(records: DataFrame, horizon: float = HORIZON_SEC, limit: int = MAX_EVENTS) -> DataFrame:
    """C2 + C3: anchor and linked events.  Nulls never match, not even each other."""
    near = neighbourhoods(records, horizon, limit)
    keys = [*LINK_KEYS[1:], "identity"]
    side = records.withColumn("identity", source_identity()).select("event_id", *keys)
    left = side.select(F.col("event_id").alias("anchor_id"), *[F.col(k).alias(f"a_{k}") for k in keys])
    right = side.select(F.col("event_id").alias("other_id"), *[F.col(k).alias(f"o_{k}") for k in keys])
    both = near.join(left.hint("merge"), "anchor_id").join(right.hint("merge"), "other_id")
    same = F.lit(True)
    for k in keys:
        same = same & F.coalesce(F.col(f"a_{k}") == F.col(f"o_{k}"), F.lit(False))
    named = F.coalesce(F.col("a_identity") != "", F.lit(False))
    return (both.filter((F.col("place") == 1) | (same & named))
            .select("anchor_id", "other_id", "other_ts", "truncated"))


def evidence_references(records: DataFrame, signals: DataFrame) -> DataFrame:
    """What an event can cite: its scores and each of its recorded signals."""
    def score(column: str, kind: str) -> DataFrame:
        return records.filter(is_number(F.col(column))).select(
            "event_id", F.lit(kind).alias("signal_type"), F.lit(column).alias("reference"))

    path = F.concat(F.lit("behavioral_evidence/"), F.col("number").cast("string"))
    cited = signals.select("event_id", F.lit("BEHAVIORAL evidence").alias("signal_type"), path.alias("reference"))
    return (score("confidence", "ML classification")
            .unionByName(score("anomaly_score", "Anomaly score")).unionByName(cited))


def timeline(records: DataFrame, signals: DataFrame) -> DataFrame:
    """Everything with a finite time that is recorded about an event."""
    def item(frame: DataFrame, at: str, kind: Column, clock: str, reference: Column) -> DataFrame:
        return frame.filter(is_number(F.col(at))).select(
            "event_id", F.col(at).cast("double").alias("timestamp"), F.lit(clock).alias("clock"),
            kind.alias("signal_type"), reference.alias("reference"))

    path = F.concat(F.lit("behavioral_evidence/"), F.col("number").cast("string"),
                    F.lit("/observation_window/end"))
    return (item(records, "timestamp", F.lit("recorded_event"), "event_timestamp_unspecified", F.lit("timestamp"))
            .unionByName(item(records, "created_at", F.lit("record_created"), "processing_time", F.lit("created_at")))
            .unionByName(item(signals, "window_end", F.lit("behavioral"), "capture_event_time", path)))


#: Fixed value: the kinds of evidence that ``evidence_references`` gives.
EVIDENCE_KINDS = ("Anomaly score", "BEHAVIORAL evidence", "ML classification")


def linked_evidence(records: DataFrame, references: DataFrame, horizon: float = HORIZON_SEC) -> DataFrame:
    """Per anchor how many events are linked and how many references of each kind they have (``n0``, ...), over all of them, listed or not."""
    count = {f"n{i}": F.count_if(F.col("signal_type") == kind) for i, kind in enumerate(EVIDENCE_KINDS)}
    cited = references.groupBy("event_id").agg(*[c.alias(n) for n, c in count.items()])
    keys = [*LINK_KEYS, "identity"]
    rows = records.withColumn("identity", source_identity()).select("event_id", "timestamp", *keys).join(cited.hint("merge"), "event_id", "left").fillna(0, list(count))
    linkable = F.coalesce(F.col("identity") != "", F.lit(False))
    for key in keys:
        linkable = linkable & F.col(key).isNotNull()
    rows = rows.withColumn("_linkable", linkable)
    within = ranges(rows.filter("_linkable"), keys, horizon, {n: F.col(n) for n in count})
    alone = rows.filter("not _linkable").select("event_id", F.lit(1).cast("long").alias("linked"), *count)
    return within.select("event_id", (F.col("high") - F.col("low")).alias("linked"), *count).unionByName(alone).withColumnRenamed("event_id", "anchor_id")


def correlations(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """One summary row per anchor; ``links`` may be cut, ``evidence`` (of ``linked_evidence``) counts everything."""
    members = links.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("other_ts", "other_id"))).alias("members"),  # at most the list's limit
        F.min("other_ts").alias("first_seen"), F.max("other_ts").alias("last_seen"),
        F.bool_or("truncated").alias("truncated"))
    names = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(kind)) for i, kind in enumerate(EVIDENCE_KINDS)]))
    total = sum((F.col(f"n{i}") for i in range(len(EVIDENCE_KINDS))), F.lit(0).cast("long"))
    counted = evidence.select("anchor_id", "linked", F.size(names).cast("long").alias("source_count"), total.alias("evidence_count"), F.array_join(names, ";").alias("source_kinds"))
    return members.join(counted.hint("merge"), "anchor_id").withColumn(
        "label", F.when(F.col("source_count") > 1, "CORRELATED OBSERVATION").otherwise("RECORDED OBSERVATION"))


def canonical_digest(*sorted_fields: Column) -> Column:
    """SHA-256 of the compact JSON whose keys are given in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted_fields)), 256)


def investigations(records: DataFrame, signals: DataFrame, horizon: float = HORIZON_SEC,
                   limit: int = MAX_EVENTS) -> DataFrame:
    """One document row per anchor, for all anchors at once."""
    summary = correlations(linked(records, horizon, limit), linked_evidence(records, evidence_references(records, signals), horizon))
    ids = F.transform("members", lambda m: m.other_id)
    return summary.select(
        "anchor_id",
        canonical_digest(F.col("anchor_id").alias("anchor"), ids.alias("events"), F.lit("1.0.0").alias("rules"))
        .alias("investigation_id"),
        "label", F.array_join(ids, ";").alias("event_ids"), "source_kinds", "source_count", "evidence_count",
        "first_seen", "last_seen", "truncated")


def documents(investigation: DataFrame) -> DataFrame:
    """One JSON text and its digest per investigation."""
    names = sorted(investigation.columns)
    body = F.to_json(F.struct(*names))
    return investigation.select("anchor_id", body.alias("document"), F.sha2(body, 256).alias("digest"))
