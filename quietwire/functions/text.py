"""Text fields: rationale, display names, formatting, allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions.keys import lookup


def threat_display(label: Column) -> Column:
    """B19."""
    return lookup(S.THREAT_DISPLAY, label, F.concat(F.lit("Model classified: "), label))


def short_rationale(score: Column, label: Column, confidence: Column,
                    threshold: float = S.ANOMALY_THRESHOLD) -> Column:
    """The one-sentence rationale of an event."""
    return F.format_string(
        f"Anomaly score: %.2f (threshold: {threshold}). Classified as %s with confidence %.2f.",
        score, label, confidence)


def evidence_line(item: Column) -> Column:
    """One evidence item in words (fields of an evidence struct)."""
    up = item["direction"] == "increase"
    name = item["feature_name"]
    model = F.concat(F.when(up, "elevated ").otherwise("reduced "), name,
                     F.format_string(" (contribution: %.3f)", item["contribution"]))
    statistical = F.concat(
        name, F.lit(" significantly "), F.when(up, "above").otherwise("below"), F.lit(" baseline"),
        F.coalesce(F.format_string(" (observed: %.2f, baseline: %.2f)", item["observed_value"],
                                   item["reference_value"]), F.lit("")),
        F.format_string(" (z-score: %.1f)", item["contribution"]))
    heuristic = F.concat(name, F.format_string(": %.2f", item["observed_value"]))
    return (F.when(item["evidence_type"] == "model", model)
             .when(item["evidence_type"] == "statistical", statistical).otherwise(heuristic))


def full_rationale(label: Column, score: Column, model: Column, confidence: Column, evidence: Column,
                   limitation: str) -> Column:
    """The multi-line rationale with the five strongest evidence items."""
    top = F.transform(F.slice(evidence, 1, 5), lambda e: F.concat(F.lit("  - "), evidence_line(e)))
    lines = F.when(F.size(evidence) > 0, F.array_join(top, "\n")).otherwise(
        "  - No significant evidence identified")
    return F.concat_ws(
        "\n", F.concat(F.lit("THREAT: "), threat_display(label)), F.lit(""),
        F.format_string("ANOMALY SCORE: %.2f", score), F.lit(""),
        F.concat(F.lit("MODEL: "), model, F.format_string(" (confidence: %.2f)", confidence)), F.lit(""),
        F.lit("EVIDENCE:"), lines, F.lit(""), F.lit(f"LIMITATION: {limitation}"))


def qualified_techniques(events: DataFrame, techniques: DataFrame) -> DataFrame:
    """Techniques of an event, worded by its confidence."""
    qualification = (F.when(F.col("confidence") >= 0.8, "likely")
                      .when(F.col("confidence") >= 0.5, "observed indicators consistent with")
                      .otherwise("possible"))
    open_classes = ~F.col("threat_type").isin("benign", "unknown", "unsupported")
    return (events.filter(open_classes).join(F.broadcast(techniques), "threat_type")
            .withColumn("qualification", qualification))


def allowed(fields: Column, *names: str) -> Column:
    """A map cut down to the listed keys."""
    return F.map_filter(fields, lambda k, v: k.isin(*names) & v.isNotNull())


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s``, without leading zero units."""
    s = F.floor(seconds)
    days, hours = F.floor(s / 86400), F.floor((s % 86400) / 3600)
    minutes, rest = F.floor((s % 3600) / 60), s % 60
    return F.concat(
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""),
        F.when((days > 0) | (hours > 0), F.concat(hours.cast("string"), F.lit("h "))).otherwise(""),
        F.when(s >= 60, F.concat(minutes.cast("string"), F.lit("m "))).otherwise(""),
        rest.cast("string"), F.lit("s"))


def bytes_text(size: Column) -> Column:
    """Bytes with the largest unit that keeps the value at or above one."""
    out = None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        test = size >= 1024 ** power
        text = F.format_string(f"%.1f {unit}", size / float(1024 ** power))
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def percent_text(score: Column) -> Column:
    """B39."""
    return F.format_string("%.1f%%", score * 100)
