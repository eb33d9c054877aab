"""The 52 flow features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import keys as K
from quietwire.functions.numbers import safe_ratio
from quietwire.operators.clock import exact_quantiles, tick
from quietwire.operators.flows import SEGMENT, border_gaps, counter_columns, finish_counters, flow_packets
from quietwire.schema import FlowParams
from quietwire.session import cut_lineage

SIZE_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}


def _size_columns() -> list[Column]:
    """Packet sizes take at most 65,536 values, so exact quantiles stay small."""
    size = F.col("ip_total_length").cast("double")
    return [
        F.avg(size).alias("pkt_size_mean"), F.stddev_pop(size).alias("pkt_size_std"),
        F.min(size).alias("pkt_size_min"), F.max(size).alias("pkt_size_max"),
        F.percentile(F.col("ip_total_length"),
                     F.array(*[F.lit(q) for q in SIZE_QUANTILES.values()])).alias("size_q"),
    ]


def _gap_columns() -> list[Column]:
    """Gap statistics over both orientations and for each of them."""
    out = [F.avg("iat").alias("iat_mean"), F.stddev_pop("iat").alias("iat_std"),
           F.min("iat").alias("iat_min"), F.max("iat").alias("iat_max")]
    for side, mask in (("lo", F.col("lo_to_hi")), ("hi", ~F.col("lo_to_hi"))):
        x = F.when(mask, F.col("iat"))
        out += [F.avg(x).alias(f"{side}_iat_mean"), F.stddev_pop(x).alias(f"{side}_iat_std"),
                F.min(x).alias(f"{side}_iat_min"), F.max(x).alias(f"{side}_iat_max")]
    return out


def _oriented_gap(stat: str, forward: bool) -> Column:
    lo_first = F.col("first_lo") if forward else ~F.col("first_lo")
    chosen = F.when(lo_first, F.col(f"lo_iat_{stat}")).otherwise(F.col(f"hi_iat_{stat}"))
    return F.coalesce(chosen, F.lit(0.0)).alias(f"{'fwd' if forward else 'rev'}_iat_{stat}")


def flow_features(packets: DataFrame, params: FlowParams = FlowParams(),
                  in_order: bool = False) -> DataFrame:
    """One row per flow with its counters and the 52 features.

    Packet rows (with their gap inside the time tile) and the gaps between tiles
    are written once and fed to one aggregation on the flow key.  The median of the
    gaps comes from value buckets of the same rows: a buffer of all distinct gaps
    of a flow could be as large as the flow.
    """
    rows = flow_packets(packets, params, in_order)
    group = [*SEGMENT, "lo_to_hi", "time_tile"]
    rows = rows.withColumn("time_tile",
                           F.col("tile") if in_order else tick(F.col("ts"), params.idle_sec))
    local = Window.partitionBy(*group).orderBy("ts", "pkt_seq")
    inner = rows.withColumn("iat", F.col("ts") - F.lag("ts").over(local))
    fed = cut_lineage(inner.unionByName(border_gaps(rows, group), allowMissingColumns=True))
    medians = exact_quantiles(fed, SEGMENT, "iat", {"iat_median": 0.5})
    grouped = fed.groupBy(*SEGMENT).agg(*counter_columns(), *_size_columns(), *_gap_columns()).join(medians.hint("merge"), SEGMENT, "left")
    zero = F.lit(0.0)
    sizes = [F.col("size_q")[i].alias(f"pkt_size_{n}") for i, n in enumerate(SIZE_QUANTILES)]
    stats = ("mean", "std", "min", "max")
    flow = finish_counters(
        grouped, *[f"pkt_size_{s}" for s in stats], *sizes,
        *[F.coalesce(f"iat_{s}", zero).alias(f"iat_{s}") for s in (*stats, "median")],
        *[_oriented_gap(s, True) for s in stats], *[_oriented_gap(s, False) for s in stats])
    return with_features(flow)


def with_features(flow: DataFrame) -> DataFrame:
    """Adds the derived features to a flow row that already has its statistics."""
    d = F.col
    pk, by = d("packet_count"), d("byte_count")
    columns = {
        "total_packets": pk, "total_bytes": by,
        "packets_per_sec": safe_ratio(pk, d("duration_sec")),
        "bytes_per_sec": safe_ratio(by, d("duration_sec")),
        "forward_packets": d("forward_packet_count"), "reverse_packets": d("reverse_packet_count"),
        "fwd_rev_packet_ratio": safe_ratio(d("forward_packet_count"), d("reverse_packet_count")),
        "fwd_rev_byte_ratio": safe_ratio(d("forward_bytes"), d("reverse_bytes")),
        **{f"{n}_ratio": safe_ratio(d(f"{n}_count"), pk) for n in ("syn", "ack", "fin", "rst", "psh")},
        "ip_version": K.ip_version("src_ip"), **K.protocol_indicators(),
        "payload_bytes_total": d("payload_byte_count"),
        "payload_ratio": safe_ratio(d("payload_byte_count"), by),
    }
    out = flow.withColumns(columns)
    return out.withColumns({f: d(f).cast("double") for f in S.FEATURES})


def feature_catalogue(spark) -> DataFrame:
    """Name, category and caveat status of every feature."""
    rows = [(i, *row) for i, row in enumerate(S.FEATURE_CATALOGUE)]
    return spark.createDataFrame(rows, "position int, feature string, category string, status string")


def features_valid(names: str = "names", values: str = "values", table: str = "features") -> Column:
    """Names, values and the name-to-value map of a feature record agree."""
    expected = F.array(*[F.lit(f) for f in S.FEATURES])
    same_length = F.size(names) == F.size(values)
    rebuilt = F.when(same_length, F.map_from_arrays(F.col(names), F.col(values)))
    agree = F.forall(F.col(names), lambda n: F.coalesce(
        F.try_element_at(rebuilt, n) == F.try_element_at(F.col(table), n), F.lit(False)))
    return F.coalesce((F.col(names) == expected) & same_length
                      & (F.size(F.map_keys(table)) == F.lit(len(S.FEATURES))) & agree, F.lit(False))


def columns_matching(frame: DataFrame, *prefixes: str) -> list[str]:
    """Column names that start with one of the prefixes, in schema order."""
    return [c for c in frame.columns if c.startswith(prefixes)]
