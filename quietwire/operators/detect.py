"""Preparation, detection, explanation and error analysis of feature rows
(B10-B14, B18, D45-D48, D58, H1, H2, H9, K1-K5, K12, K13, K18, K22-K26)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import numbers as N
from quietwire.operators.clock import exact_quantiles, with_scalars

# --------------------------------------------------------------------------
# Feature groups used by ablations and perturbations.
# --------------------------------------------------------------------------
REVERSE_FEATURES = tuple(f for f in S.FEATURES if f.startswith(("reverse_", "rev_iat_")))
RATIO_FEATURES = ("fwd_rev_packet_ratio", "fwd_rev_byte_ratio", "payload_ratio")
IAT_FEATURES = tuple(f for f in S.FEATURES if "iat_" in f)
SIZE_FEATURES = tuple(f for f in S.FEATURES if f.startswith("pkt_size_"))


# -- preparation ------------------------------------------------------------
def finite(rows: DataFrame, columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """K2: infinities and NaN become null."""
    return rows.withColumns({c: N.missing_if_not_finite(F.col(c)) for c in columns})


def long_form(rows: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return rows.unpivot([*keep], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")


def medians(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K3: exact medians, one row per feature; all-missing features have none."""
    return exact_quantiles(long_form(rows, columns), ["feature"], "value", {"median": 0.5}, few_keys=True)


def scaling_statistics(rows: DataFrame, columns: Sequence[str] = S.LINEAR_FEATURES) -> DataFrame:
    """K3 + K4: per feature the median and, after imputation with it, mean and deviation.

    A constant feature gets deviation 1.  Imputation only adds copies of the median,
    so mean and deviation follow from the moments of the present values.
    """
    long = long_form(finite(rows, columns), columns)
    moments = long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("present"), F.avg("value").alias("m"),
        F.var_pop("value").alias("v"))
    mid = exact_quantiles(long, ["feature"], "value", {"median": 0.5}, few_keys=True)
    share = F.col("present") / F.col("rows")
    mean = share * F.col("m") + (1 - share) * F.col("median")
    gap = F.col("m") - F.col("median")
    variance = share * F.col("v") + share * (1 - share) * gap * gap
    return moments.join(mid, "feature").select(
        "feature", "median", mean.alias("mean"),
        F.when(variance < 1e-20, 1.0).otherwise(F.sqrt(variance)).alias("std"), "rows", "present")


def as_arrays(statistics: DataFrame, columns: Sequence[str], *names: str) -> DataFrame:
    """A statistics table (one row per feature) as one row of arrays in ``columns`` order."""
    maps = statistics.filter(F.col("feature").isin(*columns)).agg(*[
        F.map_from_entries(F.collect_list(F.struct("feature", n))).alias(n) for n in names])
    order = F.array(*[F.lit(c) for c in columns])

    def in_order(name: str) -> Column:
        return F.transform(order, lambda c: F.try_element_at(F.col(name), c)).alias(f"{name}_of")

    return maps.select(*[in_order(n) for n in names])


def standardise(rows: DataFrame, statistics: DataFrame, columns: Sequence[str] = S.LINEAR_FEATURES) -> DataFrame:
    """K4, K5: (x - mean) / std with the statistics of the training rows.

    Features without statistics (missing in all training rows) are dropped.
    """
    known = with_scalars(finite(rows, columns), as_arrays(statistics, columns, "median", "mean", "std"))

    def of(name: str, i: int) -> Column:
        return F.get(F.col(f"{name}_of"), F.lit(i))

    scaled = known.withColumns({c: (F.coalesce(F.col(c), of("median", i)) - of("mean", i)) / of("std", i)
                                for i, c in enumerate(columns)})
    return scaled.drop("median_of", "mean_of", "std_of")


def missing_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature the share of missing rows, and whether it is constant."""
    long = long_form(finite(rows, columns), columns)
    return long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("present"), F.var_pop("value").alias("v")).select(
        "feature", (1 - F.col("present") / F.col("rows")).alias("missing_share"),
        (F.col("present") == 0).alias("all_missing"), F.coalesce(F.col("v") < 1e-8, F.lit(False)).alias("constant"))


def training_statistics(rows: DataFrame, columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """Mean and population deviation, missing values ignored, tiny deviations set to 1."""
    stats = long_form(finite(rows, columns), columns).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") < 1e-10, 1.0).otherwise(F.col("std")))


# -- public flow tables -------------------------------------------------------
def _ratio_to_packets(flag: str) -> Column:
    return N.guarded_ratio(F.col(flag), F.col("Total Fwd Packets") + F.col("Total Backward Packets"))


def cic_features() -> dict[str, tuple[Column, str]]:
    """Expression and availability of each feature in the CIC flow tables."""
    d, us = F.col, N.micros_to_seconds
    fwd, bwd = d("Total Fwd Packets"), d("Total Backward Packets")
    fb, bb = d("Fwd Packets Length Total"), d("Bwd Packets Length Total")
    direct, derived = "DIRECT", "DERIVED"
    known: dict[str, tuple[Column, str]] = {
        "duration_sec": (us(d("Flow Duration")), direct),
        "total_packets": (fwd + bwd, derived), "total_bytes": (fb + bb, derived),
        "packets_per_sec": (d("`Flow Packets/s`"), direct), "bytes_per_sec": (d("`Flow Bytes/s`"), direct),
        "forward_packets": (fwd, direct), "reverse_packets": (bwd, direct),
        "forward_bytes": (fb, direct), "reverse_bytes": (bb, direct),
        "fwd_rev_packet_ratio": (N.guarded_ratio(fwd, bwd), derived),
        "fwd_rev_byte_ratio": (N.guarded_ratio(fb, bb), derived),
        "protocol": (d("Protocol"), direct),
        "is_tcp": ((d("Protocol") == 6), derived), "is_udp": ((d("Protocol") == 17), derived),
        "is_icmp": ((d("Protocol") == 1), derived),
    }
    for stat in ("Mean", "Std", "Min", "Max"):
        known[f"pkt_size_{stat.lower()}"] = (d(f"Packet Length {stat}"), direct)
        for ours, theirs in (("iat", "Flow"), ("fwd_iat", "Fwd"), ("rev_iat", "Bwd")):
            known[f"{ours}_{stat.lower()}"] = (us(d(f"{theirs} IAT {stat}")), direct)
    for flag in ("SYN", "ACK", "FIN", "RST", "PSH"):
        known[f"{flag.lower()}_count"] = (d(f"{flag} Flag Count"), direct)
        known[f"{flag.lower()}_ratio"] = (_ratio_to_packets(f"{flag} Flag Count"), derived)
    return known


def unsw_features() -> dict[str, tuple[Column, str]]:
    """Expression and availability of each feature in the UNSW flow tables."""
    d = F.col
    packets = d("spkts") + d("dpkts")
    proto = F.lower("proto")
    return {
        "duration_sec": (d("dur"), "DIRECT"), "total_packets": (packets, "DERIVED"),
        "total_bytes": (d("sbytes") + d("dbytes"), "DERIVED"),
        "packets_per_sec": (packets / F.greatest(d("dur"), F.lit(1e-6)), "DERIVED"),
        "bytes_per_sec": (d("rate"), "PROXY"),
        "forward_packets": (d("spkts"), "DIRECT"), "reverse_packets": (d("dpkts"), "DIRECT"),
        "forward_bytes": (d("sbytes"), "DIRECT"), "reverse_bytes": (d("dbytes"), "DIRECT"),
        "fwd_rev_packet_ratio": (N.guarded_ratio(d("spkts"), d("dpkts")), "DERIVED"),
        "fwd_rev_byte_ratio": (N.guarded_ratio(d("sbytes"), d("dbytes")), "DERIVED"),
        "fwd_iat_mean": (d("sinpkt"), "PROXY"), "rev_iat_mean": (d("dinpkt"), "PROXY"),
        "protocol": (F.when(proto == "tcp", 6).when(proto == "udp", 17).when(proto == "icmp", 1).otherwise(0), "DIRECT"),
        "is_tcp": (proto == "tcp", "DERIVED"), "is_udp": (proto == "udp", "DERIVED"),
        "is_icmp": (proto == "icmp", "DERIVED"),
    }


def mapped(rows: DataFrame, mapping: Mapping[str, tuple[Column, str]], *keep: Column) -> DataFrame:
    """The 52 features of a foreign flow table; what it lacks is null."""
    columns = [mapping[f][0].cast("double").alias(f) if f in mapping else F.lit(None).cast("double").alias(f)
               for f in S.FEATURES]
    return rows.select(*keep, *columns)


def availability(spark, mapping: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """One row per feature and how the dataset provides it."""
    return spark.createDataFrame([(f, mapping[f][1] if f in mapping else "MISSING") for f in S.FEATURES],
                                 "feature string, availability string")


def canonical_label(raw: Column, table: Mapping[str, str]) -> Column:
    """Unmapped labels become ``unknown``."""
    from quietwire.functions.keys import lookup

    return lookup(dict(table), raw, F.lit("unknown"))


def unsw_raw_label(category: str = "attack_cat", label: str = "label") -> Column:
    """An empty or ``Normal`` category is decided by the binary label."""
    cat = F.trim(F.coalesce(F.col(category), F.lit("")))
    return F.when(cat.isin("", "Normal", "nan"), F.when(F.col(label) == 0, "Normal").otherwise("Generic")).otherwise(cat)


# -- explanation --------------------------------------------------------------
def _zscores(columns: Sequence[str]) -> Column:
    """|x - mean| / std of every feature, in ``columns`` order."""
    offset = F.zip_with(F.array(*[F.col(c) for c in columns]), "mean_of", lambda x, m: F.abs(x - m))
    return F.zip_with(offset, "std_of", lambda d, s: d / s)


def _items(columns: Sequence[str], keep) -> Column:
    """Evidence structs of the features whose z-score passes ``keep``, strongest first.

    The leading field is the negated score to nine decimals, so the natural order
    of the structs is by strength and then by name.
    """
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.col(c) for c in columns])
    parts = F.arrays_zip(names.alias("n"), values.alias("v"), F.col("mean_of").alias("m"), F.col("z").alias("z"))
    items = F.transform(F.filter(parts, lambda p: F.coalesce(keep(p["z"]), F.lit(False))), lambda p: F.struct(
        (-F.round(p["z"], 9)).alias("place"), p["n"].alias("feature_name"), p["z"].alias("contribution"),
        p["v"].alias("observed_value"), p["m"].alias("reference_value"),
        F.when(p["v"] > p["m"], "increase").otherwise("decrease").alias("direction"),
        F.lit("statistical").alias("evidence_type")))
    return F.array_sort(items)


def with_evidence(rows: DataFrame, statistics: DataFrame, columns: Sequence[str] = S.FEATURES,
                  minimum: float = 2.0) -> DataFrame:
    """H1: adds ``evidence``, the features at least ``minimum`` deviations off, strongest first.

    The 52 values of a row are compared inside the row; nothing is exploded or shuffled.
    """
    known = with_scalars(rows, as_arrays(statistics, columns, "mean", "std")).withColumn("z", _zscores(columns))
    return known.withColumn("evidence", _items(columns, lambda z: z >= minimum)).drop("mean_of", "std_of", "z")


def top_deviations(rows: DataFrame, statistics: DataFrame, columns: Sequence[str] = S.FEATURES,
                   k: int = 5) -> DataFrame:
    """Adds ``top``, the ``k`` features furthest from the training mean."""
    known = with_scalars(rows, as_arrays(statistics, columns, "mean", "std")).withColumn("z", _zscores(columns))
    present = _items(columns, lambda z: z.isNotNull())
    return known.withColumn("top", F.slice(present, 1, k)).drop("mean_of", "std_of", "z")


def explanation(evidence: Column, baseline: Column) -> Column:
    """H9: the explanation struct; without a baseline it says so."""
    reason = F.when(~baseline, "Training baseline not supplied to anomaly explainer.")
    return F.struct(F.when(baseline, evidence).alias("items"), baseline.alias("explanation_available"),
                    reason.alias("unavailable_reason"))


def merged_evidence(first: str, second: str) -> Column:
    """H3: two evidence collections as one: items sorted by strength, available if either is."""
    a, b = F.col(first), F.col(second)
    none = F.slice(F.array(F.get(a["items"], F.lit(0))), 1, 0)
    items = F.concat(F.coalesce(a["items"], none), F.coalesce(b["items"], none))
    either = F.coalesce(a["explanation_available"], F.lit(True)) | F.coalesce(b["explanation_available"], F.lit(True))
    reasons = F.array_join(F.array_compact(F.array(a["unavailable_reason"], b["unavailable_reason"])), "; ")
    return F.struct(F.array_sort(items).alias("items"), either.alias("explanation_available"),
                    F.when(~either, reasons).alias("unavailable_reason"))


# -- error analysis -------------------------------------------------------------
def failure_codes(rows: DataFrame, statistics: DataFrame, class_share: DataFrame, threshold: float = 0.5,
                  columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """H2: codes of every wrongly classified row.

    Columns used: label, pred, anomaly_score and the features.  ``class_share`` has
    one row per training class (label, share).
    """
    wrong = rows.filter(F.col("label") != F.col("pred"))
    known = with_scalars(wrong, as_arrays(statistics, columns, "mean", "std"))
    known = known.join(F.broadcast(class_share), "label", "left")  # one row per class
    known = known.withColumn("z", _zscores(columns))
    extreme = F.size(F.filter("z", lambda v: F.coalesce(v > 3.0, F.lit(False))))
    is_fp = (F.col("label") == "benign") & (F.col("pred") != "benign")
    silent = F.lit(True)
    for c in REVERSE_FEATURES:
        silent = silent & F.coalesce(F.abs(F.col(c)) <= 1e-10, F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.abs(F.col("anomaly_score") - threshold) < 0.1, "F3"),
        F.when(F.coalesce("share", F.lit(0.0)) < 0.05, "F6"),
        F.when((extreme > 3) | (F.coalesce(F.array_max("z") > 5.0, F.lit(False))), "F7"),
        F.when(silent & ~is_fp, "F2"),
        F.when(F.col("total_packets") < 3, "F9"),
        F.when(F.col("label").isin("other", "unknown"), "F8")))
    return known.withColumns({
        "failure_type": F.when(is_fp, "false_positive").otherwise("false_negative"),
        "codes": F.when(F.size(codes) == 0, F.array(F.lit("F1"))).otherwise(codes)}).drop("mean_of", "std_of", "share", "z")


def failure_counts(failures: DataFrame) -> DataFrame:
    """Rows per code, codes that never occur included."""
    counted = failures.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    table = failures.sparkSession.createDataFrame(list(S.FAILURE_CODES), "code string, meaning string")
    return table.join(counted, "code", "left").select("code", "meaning", F.coalesce("n", F.lit(0)).alias("n"))


# -- perturbations -------------------------------------------------------------
def _uniform(identity: str, name: str, seed: int) -> Column:
    """A number in (0, 1) fixed by row, column and seed (13 digits of an MD5), so that a retried task, or another engine, repeats it."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col(identity), F.lit(name), F.lit(str(seed))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def _normal(identity: str, name: str, seed: int) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(identity, name, seed)))
    return radius * F.cos(_uniform(identity, name, seed + 7919) * 6.283185307179586)


def timing_jitter(rows: DataFrame, identity: str, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """K22; missing values stay missing."""
    return rows.withColumns({c: F.col(c) + _normal(identity, c, seed) * noise for c in IAT_FEATURES})


def size_noise(rows: DataFrame, identity: str, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Sizes do not fall below zero."""
    def noisy(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c) + _normal(identity, c, seed) * noise, F.lit(0.0)))

    return rows.withColumns({c: noisy(c) for c in SIZE_FEATURES})


def duration_scaling(rows: DataFrame, identity: str, scale: float = 0.2, seed: int = 42) -> DataFrame:
    """K22."""
    factor = 1 + (_uniform(identity, "duration_sec", seed) * 2 - 1) * scale
    return rows.withColumn("duration_sec", F.col("duration_sec") * factor)


def random_drop(rows: DataFrame, identity: str, share: float = 0.2, seed: int = 42,
                columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """Zeroes a random share of the values; missing ones stay missing."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull() & (_uniform(identity, c, seed) < share), 0.0)
                             .otherwise(F.col(c)) for c in columns})


def zeroed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns set to zero."""
    return rows.withColumns({c: F.lit(0.0) for c in columns})


def one_directional(rows: DataFrame, with_ratios: bool = True) -> DataFrame:
    """The rows as a sensor sees them that misses the reverse direction."""
    return zeroed(rows, [*REVERSE_FEATURES, *(RATIO_FEATURES if with_ratios else ())])


def missing_as_zero(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K18."""
    return finite(rows, columns).fillna(0.0, list(columns))


def probes(statistics: DataFrame, copies: int = 10) -> DataFrame:
    """Rows unlike the training data, built from its column statistics.

    ``copies`` rows per kind; the small noise of each is fixed by its number.
    """
    one = as_arrays(statistics, S.FEATURES, "mean", "std")

    def base(c: str) -> Column:
        return F.coalesce(F.get("mean_of", F.lit(S.FEATURES.index(c))), F.lit(0.0))

    def spread(c: str) -> Column:
        return F.coalesce(F.get("std_of", F.lit(S.FEATURES.index(c))), F.lit(1.0))

    kinds = {
        "extreme_packet_sizes": {c: base(c) + spread(c) * 5 for c in SIZE_FEATURES},
        "extreme_duration": {"duration_sec": base("duration_sec") + spread("duration_sec") * 10},
        "all_zero_features": {c: F.lit(0.0) for c in S.FEATURES},
        "unusual_protocol": {"protocol": F.lit(47.0), "is_tcp": F.lit(0.0), "is_udp": F.lit(0.0), "is_icmp": F.lit(0.0)},
        "fully_asymmetric": {c: F.lit(0.0) for c in REVERSE_FEATURES},
    }
    numbered = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    out = None
    for kind, special in kinds.items():
        noise = 0.0 if kind == "all_zero_features" else 0.01
        columns = []
        for c in S.FEATURES:
            x = special.get(c, base(c)) + _normal("copy", f"{kind}:{c}", 42) * spread(c) * noise
            if kind == "fully_asymmetric" and c in REVERSE_FEATURES:
                x = F.greatest(x, F.lit(0.0))
            columns.append(x.alias(c))
        frame = numbered.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}-"), F.col("copy").cast("string")).alias("row_id"), *columns)
        out = frame if out is None else out.unionByName(frame)
    return out


def probe_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """K26."""
    return scored.groupBy("kind").agg(
        F.count("*").alias("n"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
        F.count_if(F.col("score") >= threshold).alias("flagged"))


def benign_only(rows: DataFrame, label: str = "label") -> DataFrame:
    """K13."""
    return rows.filter(F.col(label) == "benign")


def detections(scored: DataFrame, min_confidence: float = S.MIN_CONFIDENCE,
               threshold: float = S.ANOMALY_THRESHOLD) -> DataFrame:
    """Scored and classified rows as detections (score, pred, confidence -> event fields)."""
    from quietwire.functions.text import short_rationale

    label = N.relabel_unsure(F.col("pred"), F.col("confidence"), min_confidence)
    return scored.withColumns({
        "classification_score_class": F.col("pred"), "threat_type": label,
        "severity": N.severity(F.col("score")), "is_anomalous": N.is_anomalous(F.col("score"), threshold),
        "rationale": short_rationale(F.col("score"), label, F.col("confidence"), threshold)})
