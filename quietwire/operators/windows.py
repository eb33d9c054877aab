"""Trailing event-time windows at bucket resolution.

A window value changes only when a bucket enters or leaves the window.  Each
series is therefore turned into *changes*, ``+v`` at its tick and ``-v`` one
window later, summed per (key, tick) before any ordering, and a running sum in
tick order gives the value at every point of interest.  The cost is linear in
the series, whatever the window length, and a task orders at most one row per
tick and key: the length of the capture bounds it, not the traffic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.functions.numbers import safe_ratio
from quietwire.operators.clock import tick
from quietwire.schema import FlowParams, WindowParams
from quietwire.session import cut_lineage

PAIR = ["src_ip", "dst_ip", "protocol", "dst_port"]


def x_log2_x(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def changes(series: DataFrame, keys: Sequence[str], values: Sequence[str], span: int) -> DataFrame:
    """``+v`` on entering and ``-v`` on leaving a window of ``span`` ticks."""
    leave = series.select(*keys, (F.col("tick") + span).alias("tick"),
                          *[(-F.col(v)).alias(v) for v in values])
    return series.select(*keys, "tick", *values).unionByName(leave)


def values_at(change: DataFrame, points: DataFrame, keys: Sequence[str],
              values: Sequence[str]) -> DataFrame:
    """Running value of every change column at the (key, tick) points asked for."""
    asked = points.select(*keys, "tick").distinct().withColumn("asked", F.lit(1))
    merged = (change.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "tick")
              .agg(*[F.sum(v).alias(v) for v in values], F.max("asked").alias("asked")))
    through = (Window.partitionBy(*keys).orderBy("tick")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = merged.select(*keys, "tick", "asked", *[
        F.coalesce(F.sum(v).over(through), F.lit(0)).alias(v) for v in values])
    return running.filter("asked = 1").drop("asked")


def member_changes(members: DataFrame, keys: Sequence[str], member: str, span: int,
                   prefix: str) -> DataFrame:
    """Changes of the distinct count and of sum(n*log2 n) of a multiset.

    ``members`` has columns keys, tick, member, n.  Ordering happens inside one
    (key, member), so a key with very many members is spread over them.
    """
    own = [*keys, member]
    steps = (changes(members, own, ["n"], span).groupBy(*own, "tick").agg(F.sum("n").alias("d")))
    through = (Window.partitionBy(*own).orderBy("tick")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.col("after")
    before = after - F.col("d")
    return (steps.withColumn("after", F.sum("d").over(through)).groupBy(*keys, "tick")
            .agg(F.sum((after > 0).cast("long") - (before > 0).cast("long")).alias(f"{prefix}_distinct"),
                 F.sum(x_log2_x(after) - x_log2_x(before)).alias(f"{prefix}_nlogn")))


def entropy_bits(total: Column, nlogn: Column) -> Column:
    """Shannon entropy of a multiset from its size and sum(n*log2 n).

    Rounded to nine decimals: running sums of logarithms carry a last-digit error.
    """
    return F.when(total > 0, F.round(F.log2(total.cast("double")) - nlogn / total, 9)).otherwise(0.0)


def closing_ticks(flow: DataFrame, packets: DataFrame, flow_params: FlowParams,
                  params: WindowParams) -> DataFrame:
    """The tick of the packet at which each flow is closed and evaluated.

    A flow ends with its own RST, else with the first packet of the capture at or
    after its idle or FIN deadline, else at the end of the capture.  Flows whose
    end already left the window at that moment carry no evidence (``in_window``).
    """
    width = params.bucket_sec
    end_tick = tick(F.col("end_time"), width)
    due = F.least(F.col("end_time") + flow_params.idle_sec,
                  F.coalesce(F.col("first_fin_ts") + flow_params.fin_grace_sec,
                             F.lit(float("inf"))))
    flow = flow.withColumns({"end_tick": end_tick, "due": due, "tick": tick(due, width)})
    ticks = packets.groupBy(tick(F.col("ts"), width).alias("tick")).agg(F.max("ts").alias("top_ts"))
    asked = flow.select("tick").distinct()
    # one row per tick of the capture; running backwards finds the next busy tick
    later = (Window.partitionBy(F.lit(0)).orderBy(F.col("tick").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.partitionBy(F.lit(0))
    table = (ticks.unionByName(asked, allowMissingColumns=True)
             .groupBy("tick").agg(F.max("top_ts").alias("top_ts")))
    busy = F.when(F.col("top_ts").isNotNull(), F.col("tick"))
    table = table.select("tick", "top_ts", F.min(busy).over(later).alias("next_tick"),
                         F.max(busy).over(everything).alias("last_tick"))
    joined = flow.join(table, "tick")
    reached = (F.when(F.col("rst_count") > 0, F.col("end_tick"))
                .when(F.col("top_ts") >= F.col("due"), F.col("tick"))
                .otherwise(F.coalesce("next_tick", "last_tick")))
    return (joined.withColumn("eval_tick", reached)
            .withColumn("in_window", F.col("end_tick") > F.col("eval_tick") - params.span)
            .drop("due", "tick", "top_ts", "next_tick", "last_tick"))


def destination_series(packets: DataFrame, flow: DataFrame, width: float) -> DataFrame:
    """Per destination and tick packets, SYNs without ACK, UDP packets, new flows."""
    flags = F.coalesce("tcp_flags", F.lit(0))
    syn = (F.col("protocol") == 6) & (flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(16) == 0)
    traffic = (packets.groupBy("dst_ip", tick(F.col("ts"), width).alias("tick"))
               .agg(F.count("*").alias("packets"), F.count_if(syn).alias("syn"),
                    F.count_if(F.col("protocol") == 17).alias("udp")))
    opened = (flow.groupBy("dst_ip", tick(F.col("start_time"), width).alias("tick"))
              .agg(F.count("*").alias("flows"), F.count_if(F.col("protocol") == 17).alias("udp_flows")))
    both = traffic.unionByName(opened, allowMissingColumns=True)
    names = ["packets", "syn", "udp", "flows", "udp_flows"]
    return both.groupBy("dst_ip", "tick").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _counted(rows: DataFrame, keys: Sequence[str], ts: str, width: float) -> DataFrame:
    return rows.groupBy(*keys, tick(F.col(ts), width).alias("tick")).agg(F.count("*").alias("n"))


def destination_windows(packets: DataFrame, flow: DataFrame, points: DataFrame,
                        params: WindowParams) -> DataFrame:
    """D12, D14, D15 at (dst_ip, tick) points."""
    names = ["packets", "syn", "udp", "flows", "udp_flows"]
    width, span = params.bucket_sec, params.span
    series = changes(destination_series(packets, flow, width), ["dst_ip"], names, span)
    sources = member_changes(_counted(packets, ["dst_ip", "src_ip"], "ts", width),
                             ["dst_ip"], "src_ip", span, "source")
    every = series.unionByName(sources, allowMissingColumns=True)
    out = values_at(every, points, ["dst_ip"], [*names, "source_distinct", "source_nlogn"])
    return out.withColumn("source_entropy", entropy_bits(F.col("packets"), F.col("source_nlogn")))


def source_windows(flow: DataFrame, points: DataFrame, params: WindowParams) -> DataFrame:
    """D13, D18 at (src_ip, tick) points: sessions, distinct hosts, distinct ports."""
    width, span = params.bucket_sec, params.span
    sessions = changes(_counted(flow, ["src_ip"], "start_time", width)
                       .withColumnRenamed("n", "sessions"), ["src_ip"], ["sessions"], span)
    hosts = member_changes(_counted(flow, ["src_ip", "dst_ip"], "start_time", width),
                           ["src_ip"], "dst_ip", span, "host")
    ports = member_changes(
        _counted(flow.filter("dst_port is not null"), ["src_ip", "dst_port"], "start_time", width),
        ["src_ip"], "dst_port", span, "port")
    every = (sessions.unionByName(hosts, allowMissingColumns=True)
             .unionByName(ports, allowMissingColumns=True))
    return values_at(every, points, ["src_ip"], ["sessions", "host_distinct", "port_distinct"])


def concentration_windows(flow: DataFrame, points: DataFrame, params: WindowParams) -> DataFrame:
    """Sessions of a source that went to one destination."""
    keys = ["src_ip", "dst_ip"]
    series = _counted(flow, keys, "start_time", params.bucket_sec).withColumnRenamed("n", "to_destination")
    return values_at(changes(series, keys, ["to_destination"], params.span), points, keys,
                     ["to_destination"])


def _null_safe(frame: DataFrame) -> DataFrame:
    """A missing port is a value of its own in session keys."""
    return frame.withColumn("dst_port", F.coalesce("dst_port", F.lit(-1)))


GAP_SUMS = ["n_times", "gaps", "gap_us", "gap_us_sq"]


def session_gap_changes(flow: DataFrame, width: float, span: int) -> DataFrame:
    """Changes of the number of sessions, of gaps, and of their sum and sum of squares per (PAIR, tick).

    A gap counts while both of its sessions are in the window: from the later one's
    tick until the earlier one leaves.  Sums are whole microseconds in decimals, so what
    leaves cancels exactly.  Gaps are formed inside a tick; the gap between two
    ticks joins their ends, so no pair is ordered session by session.
    """
    sessions = flow.select(*PAIR, "start_time", "first_seq", tick(F.col("start_time"), width).alias("tick"))
    local = Window.partitionBy(*PAIR, "tick").orderBy("start_time", "first_seq")
    inner = sessions.select(*PAIR, "tick", F.col("tick").alias("from_tick"), (F.col("start_time") - F.lag("start_time").over(local)).alias("gap"))
    ends = sessions.groupBy(*PAIR, "tick").agg(F.min("start_time").alias("head"), F.max("start_time").alias("tail"), F.count("*").alias("n"))
    before = Window.partitionBy(*PAIR).orderBy("tick")
    border = ends.select(*PAIR, "tick", F.lag("tick").over(before).alias("from_tick"), (F.col("head") - F.lag("tail").over(before)).alias("gap"))
    us = F.round(F.col("gap") * 1_000_000).cast("decimal(19,0)")
    gaps = inner.unionByName(border).filter(F.col("gap").isNotNull() & (F.col("tick") - F.col("from_tick") < span)).select(
        *PAIR, "tick", "from_tick", F.lit(1).cast("long").alias("gaps"), us.cast("decimal(38,0)").alias("gap_us"), (us * us).cast("decimal(38,0)").alias("gap_us_sq"))
    enter = gaps.drop("from_tick")
    leave = gaps.select(*PAIR, (F.col("from_tick") + span).alias("tick"), *[(-F.col(n)).alias(n) for n in GAP_SUMS[1:]])
    counts = changes(ends.withColumnRenamed("n", "n_times"), PAIR, ["n_times"], span)
    return counts.unionByName(enter.unionByName(leave), allowMissingColumns=True)


def pair_windows(flow: DataFrame, points: DataFrame, params: WindowParams) -> DataFrame:
    """D17, D19 at (PAIR, tick) points: sessions with the statistics of their gaps, and directional bytes."""
    width, span = params.bucket_sec, params.span
    heavy = (F.greatest("forward_bytes", "reverse_bytes").cast("double")
             / F.greatest(F.least("forward_bytes", "reverse_bytes"), F.lit(1))) >= params.directional_ratio
    forward = F.col("forward_bytes") >= F.col("reverse_bytes")
    names = ["fwd_bytes", "rev_bytes", "heavy_forward", "heavy_reverse"]
    bytes_of = flow.filter("in_window").select(
        *PAIR, F.col("eval_tick"), (F.col("end_tick") + span).alias("gone"),
        F.col("forward_bytes").alias("fwd_bytes"), F.col("reverse_bytes").alias("rev_bytes"),
        (heavy & forward).cast("long").alias("heavy_forward"),
        (heavy & ~forward).cast("long").alias("heavy_reverse"))
    enter = bytes_of.withColumnRenamed("eval_tick", "tick").drop("gone")
    leave = bytes_of.select(*PAIR, F.col("gone").alias("tick"), *[(-F.col(n)).alias(n) for n in names])
    every = enter.unionByName(leave).unionByName(session_gap_changes(flow, width, span), allowMissingColumns=True)
    return values_at(every, points, PAIR, [*names, *GAP_SUMS])


def gap_statistics() -> dict[str, Column]:
    """Mean, population deviation and coefficient of variation of the gaps, from their sums."""
    n, total = F.when(F.col("gaps") > 0, F.col("gaps").cast("double")), F.col("gap_us").cast("double")
    mean = total / n / 1_000_000
    # n * sum of squares - square of the sum, before anything is rounded
    spread = (F.col("gaps").cast("decimal(10,0)") * F.col("gap_us_sq").cast("decimal(27,0)")
              - F.col("gap_us").cast("decimal(19,0)") * F.col("gap_us").cast("decimal(19,0)"))
    deviation = F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n / 1_000_000
    return {"gap_mean": mean, "gap_std": deviation,
            "gap_cv": F.when(mean > 0, F.try_divide(deviation, mean))}


def flow_windows(packets: DataFrame, flow: DataFrame, flow_params: FlowParams,
                 params: WindowParams) -> DataFrame:
    """Every flow with the destination, source and pair windows at its closing tick."""
    # eight passes over the flow table follow, so it is written once
    flow = cut_lineage(_null_safe(closing_ticks(flow, packets, flow_params, params)))
    judged = flow.filter("in_window").withColumn("tick", F.col("eval_tick"))
    return (judged
            .join(destination_windows(packets, flow, judged, params).hint("merge"), ["dst_ip", "tick"])
            .join(source_windows(flow, judged, params).hint("merge"), ["src_ip", "tick"])
            .join(concentration_windows(flow, judged, params).hint("merge"), ["src_ip", "dst_ip", "tick"])
            .join(pair_windows(flow, judged, params).hint("merge"), [*PAIR, "tick"])
            .withColumn("concentration", safe_ratio(F.col("to_destination"), F.col("sessions")))
            .withColumns(gap_statistics())
            .withColumn("window_start", (F.col("tick") - params.span + 1) * params.bucket_sec)
            .withColumn("window_end", (F.col("tick") + 1) * params.bucket_sec))
