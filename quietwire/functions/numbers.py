"""Numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietwire import schema as S


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 when the denominator is 0 (division by zero is an error in ANSI mode)."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """The denominator is raised to at least 1."""
    return numerator.cast("double") / F.greatest(denominator.cast("double"), F.lit(1.0))


def micros_to_seconds(value: Column) -> Column:
    """B9."""
    return value.cast("double") / F.lit(1_000_000.0)


def severity(score: Column) -> Column:
    """B15."""
    out = None
    for cut, name in S.SEVERITIES:
        test = score >= F.lit(cut)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("info")


def is_anomalous(score: Column, threshold: float = S.ANOMALY_THRESHOLD) -> Column:
    """B16."""
    return score >= F.lit(threshold)


def relabel_unsure(label: Column, confidence: Column, minimum: float = S.MIN_CONFIDENCE) -> Column:
    """A weak prediction is reported as ``unknown``."""
    return F.when(confidence < F.lit(minimum), F.lit("unknown")).otherwise(label)


def is_number(value: Column) -> Column:
    """Present and finite."""
    v = value.cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def missing_if_not_finite(value: Column) -> Column:
    """K2: NaN and infinities become null so that aggregates skip them."""
    v = value.cast("double")
    return F.when(is_number(v), v)


def row_hash(columns: Sequence[str]) -> Column:
    """Identity of a numeric row."""
    parts = [F.coalesce(F.col(c).cast("double").cast("string"), F.lit("null")) for c in columns]
    return F.sha2(F.concat_ws(":", *parts), 256)
