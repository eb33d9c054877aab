"""Packets to bidirectional flows.

A conversation is cut into flows by three rules: silence of ``idle_sec``, an
RST packet, and a FIN followed by ``fin_grace_sec``.  The number of the flow
inside its conversation is kept as three counters,

``epoch``   silences seen so far,
``rst_no``  RST packets seen before this one,
``fin_no``  FIN deadlines passed inside (epoch, rst_no),

because each of them can be carried across tiles on its own.  A tile is
``idle_sec`` of the arrival clock: packets of one tile are never an idle gap
apart, so the silences follow from one summary row per (conversation, tile)
and a conversation with very many packets is spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.functions import keys as K
from quietwire.operators.clock import arrival_watermark, tick, with_carry
from quietwire.schema import FlowParams

SEGMENT = ["direction_key", "epoch", "rst_no", "fin_no"]
_COARSE = ["direction_key", "epoch", "rst_no"]
_TILE = ["direction_key", "tile"]


def keyed_packets(packets: DataFrame, params: FlowParams, in_order: bool) -> DataFrame:
    """Adds the conversation key, orientation, flag marks, arrival clock and tile."""
    clocked = packets.withColumn("wm", F.col("ts")) if in_order else arrival_watermark(packets)
    marks = {f"is_{n}": c for n, c in K.flag_marks().items()}
    rows = clocked.withColumn("lo_to_hi", K.low_to_high()).withColumns({
        "direction_key": K.direction_key(F.col("lo_to_hi")),
        "tile": tick(F.col("wm"), params.idle_sec), **marks,
    })
    closes = F.col("is_rst") | F.col("is_fin") if params.fin_grace_sec == 0 else F.col("is_rst")
    return rows.withColumn("closes", closes)


def _silences(rows: DataFrame, params: FlowParams, in_order: bool) -> tuple[DataFrame, DataFrame]:
    """Per-tile ``epoch``/``rst`` carry, and the rows (with ``epoch`` when out of order)."""
    idle, none = F.lit(params.idle_sec), F.lit(0).cast("long")
    if in_order:
        summary = rows.groupBy(*_TILE).agg(
            F.min("wm").alias("first_wm"), F.max("ts").alias("top_ts"),
            F.count_if("closes").alias("n_close"))
        state = with_carry(summary, ["direction_key"], "tile",
                           {"prior_ts": F.max("top_ts"), "rst_before": F.sum("n_close")})
        through = (Window.partitionBy("direction_key").orderBy("tile")
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        opens = F.coalesce(F.col("first_wm") - F.col("prior_ts") >= idle, F.lit(False))
        state = state.withColumn("epoch", F.count_if(opens).over(through))
        state = state.withColumn("epoch_before", F.col("epoch") - opens.cast("long"))
    else:
        # late packets can leave a silence inside a tile: test every row, against the newest timestamp since the last closing packet
        before = (Window.partitionBy(*_TILE).orderBy("pkt_seq")
                  .rowsBetween(Window.unboundedPreceding, -1))
        through = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_part", F.count_if("closes").over(before))
        parts = rows.groupBy(*_TILE).agg(F.count_if("closes").alias("n_close"), F.max(F.struct("_part", "ts")).alias("tail"))
        parts = parts.withColumn("tail_ts", F.when(F.col("tail._part") == F.col("n_close"), F.col("tail.ts")))
        along = Window.partitionBy("direction_key").orderBy("tile")
        # tiles from the last one with a closing packet on share a run; what it has seen goes on to the next tile
        parts = parts.withColumn("run", F.count_if(F.col("n_close") > 0).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        held = F.max("tail_ts").over(Window.partitionBy("direction_key", "run").orderBy("tile").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        carry = parts.withColumn("held", held).withColumn("prior_ts", F.lag("held").over(along)).select(*_TILE, "prior_ts")
        rows = rows.join(carry.hint("merge"), _TILE)
        inside = Window.partitionBy(*_TILE, "_part").orderBy("pkt_seq").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.greatest(F.max("ts").over(inside), F.when(F.col("_part") == 0, F.col("prior_ts")))
        rows = rows.withColumn("opens", F.coalesce(F.col("wm") - seen >= idle, F.lit(False)))
        per_tile = rows.groupBy(*_TILE).agg(F.count_if("opens").alias("n_open"),
                                            F.count_if("closes").alias("n_close"))
        state = with_carry(per_tile, ["direction_key"], "tile",
                           {"epoch_before": F.sum("n_open"), "rst_before": F.sum("n_close")})
        state = state.withColumn("epoch_before", F.coalesce("epoch_before", none))
        rows = rows.withColumn("opened", F.count_if("opens").over(through)).drop("prior_ts", "opens", "_part")
    state = state.withColumn("rst_before", F.coalesce("rst_before", none))
    columns = [*_TILE, "epoch_before", "rst_before", *(["epoch"] if in_order else [])]
    return state.select(*columns), rows


def _numbered(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the ``epoch`` and ``rst_no`` they belong to."""
    local = (Window.partitionBy(*_TILE).orderBy("pkt_seq")
             .rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(state.hint("merge"), _TILE).withColumn(
        "rst_no", F.col("rst_before") + F.count_if("closes").over(local))
    if "opened" in rows.columns:
        out = out.withColumn("epoch", F.col("epoch_before") + F.col("opened")).drop("opened")
    return out


def _fin_deadlines(rows: DataFrame, state: DataFrame, params: FlowParams) -> DataFrame:
    """The FINs that start a grace period, and where each period ends.

    Only FIN (and RST) packets take part.  A FIN counts when no period is open
    at its arrival; the position ``(at, after_seq)`` is the point on the arrival
    clock from which packets belong to the next flow.

    A FIN that arrives when the periods of all earlier FINs would be over opens one
    in any case.  Such FINs cut the FINs of a flow into islands, numbered with tile
    carry, and only the FINs of one island are gathered.
    """
    grace = F.lit(params.fin_grace_sec)
    marked = _numbered(rows.filter(F.col("is_fin") | F.col("closes")), state)
    place = [*_COARSE, "tile"]
    fins = marked.filter("is_fin and not closes").select(*place, "pkt_seq", "wm", (F.col("ts") + grace).alias("due"))
    local = Window.partitionBy(*place).orderBy("pkt_seq")
    latest = with_carry(fins.groupBy(*place).agg(F.max("due").alias("top")), _COARSE, "tile", {"due_before": F.max("top")}).drop("top")
    open_until = F.greatest(F.max("due").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col("due_before"))
    fins = fins.join(latest.hint("merge"), place).withColumn("starts", F.coalesce(F.col("wm") >= open_until, F.lit(True)).cast("long")).drop("due_before")
    numbers = with_carry(fins.groupBy(*place).agg(F.sum("starts").alias("n")), _COARSE, "tile", {"n_before": F.sum("n")}).drop("n")
    through = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fins = fins.join(numbers.hint("merge"), place).withColumn("island", F.coalesce("n_before", F.lit(0)) + F.sum("starts").over(through))
    kept = fins.groupBy(*_COARSE, "island").agg(F.aggregate(
        F.array_sort(F.collect_list(F.struct("pkt_seq", "wm", "due"))),
        F.expr("cast(array() as array<struct<pkt_seq:bigint,wm:double,due:double>>)"),
        lambda acc, f: F.when(
            (F.size(acc) == 0) | (f.wm >= F.coalesce(F.try_element_at(acc, F.lit(-1)).due, f.wm)),
            F.array_append(acc, f)).otherwise(acc)).alias("kept"))
    at = F.greatest("f.due", "f.wm")
    return (kept.select(*_COARSE, F.explode("kept").alias("f"))
            .select(*_COARSE, at.alias("at"),
                    F.when(F.col("f.due") > F.col("f.wm"), F.lit(-1).cast("long"))
                     .otherwise(F.col("f.pkt_seq")).alias("after_seq"),
                    tick(at, params.idle_sec).alias("tile")))


def _with_fin_carry(state: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Adds per tile the number of deadlines passed before it.

    Only the flow that was open when a tile began can be ended by a deadline of
    an earlier tile, so one counter per tile is enough.
    """
    inside = deadlines.groupBy(*_COARSE, "tile").agg(F.count("*").alias("n"))
    begun = state.withColumnsRenamed({"epoch": "tile_epoch"}).withColumns(
        {"epoch": F.col("epoch_before"), "rst_no": F.col("rst_before")})
    timeline = begun.unionByName(inside, allowMissingColumns=True)
    earlier = Window.partitionBy(*_COARSE).orderBy("tile").rangeBetween(
        Window.unboundedPreceding, -1)
    timeline = timeline.withColumn("fin_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return (timeline.filter("epoch_before is not null").drop("epoch", "rst_no", "n")
            .withColumnsRenamed({"tile_epoch": "epoch"}))


def _with_passed(rows: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Adds ``passed``, the deadlines of the row's own (epoch, rst_no) that lie before it in its tile.

    Deadlines are laid among the packets and counted along the arrival clock, so a
    packet carries one number however many flows end in its tile.
    """
    points = deadlines.select(*_COARSE, "tile", F.col("at").alias("_at"), F.col("after_seq").alias("_seq"), F.lit(1).alias("_point"))
    placed = rows.withColumns({"_at": F.col("wm"), "_seq": F.col("pkt_seq"), "_point": F.lit(0)})
    along = (Window.partitionBy(*_COARSE, "tile").orderBy("_at", "_seq", "_point")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = placed.unionByName(points, allowMissingColumns=True).withColumn("passed", F.sum("_point").over(along))
    return both.filter("_point = 0").drop("_at", "_seq", "_point")


def flow_packets(packets: DataFrame, params: FlowParams = FlowParams(), in_order: bool = False) -> DataFrame:
    """Every packet with the flow it belongs to (columns ``SEGMENT``).

    ``in_order=True`` states that ``ts`` never falls along ``pkt_seq``; it saves
    the watermark pass.  Otherwise the arrival watermark is the clock.
    """
    rows = keyed_packets(packets, params, in_order)
    state, rows = _silences(rows, params, in_order)
    if params.fin_grace_sec > 0:
        deadlines = _fin_deadlines(rows, state, params)
        state = _with_fin_carry(state, deadlines)
    out = _numbered(rows, state)
    if params.fin_grace_sec > 0:
        out = _with_passed(out, deadlines)
        continues = ((F.col("epoch") == F.col("epoch_before"))
                     & (F.col("rst_no") == F.col("rst_before")))
        carry = F.when(continues, F.col("fin_before")).otherwise(F.lit(0))
        out = out.withColumn("fin_no", (carry + F.col("passed")).cast("long")).drop("passed", "fin_before")
    else:
        out = out.withColumn("fin_no", F.lit(0).cast("long"))
    return out.drop("epoch_before", "rst_before")


def counter_columns() -> list[Column]:
    """D3 aggregates per orientation; rows without ``pkt_seq`` are gap rows and count nothing."""
    lo = F.col("lo_to_hi")
    # arrival number and orientation of the first packet in one integer, so that
    # the whole aggregation works on fixed-width buffers
    coded = F.col("pkt_seq") * 2 + F.when(lo, 0).otherwise(1)

    def directed(name: str, value: Column) -> list[Column]:
        return [F.sum(value).alias(f"{name}_all"),
                F.sum(F.when(lo, value).otherwise(F.lit(0))).alias(f"{name}_lo")]

    return [
        F.min(coded).alias("first_coded"), F.max("pkt_seq").alias("last_seq"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.min(F.when(F.col("is_fin"), F.col("ts"))).alias("first_fin_ts"),
        *directed("packets", F.col("pkt_seq").isNotNull().cast("long")),
        *directed("bytes", F.col("ip_total_length").cast("long")),
        *directed("payload", F.col("payload_size").cast("long")),
        *[F.count_if(f"is_{n}").alias(f"{n}_count")
          for n in ("syn", "syn_ack", "ack", "fin", "rst", "psh")],
    ]


def oriented(low: str, total: str, forward: bool) -> Column:
    """A per-orientation counter as seen from the first packet of the flow."""
    lo, hi = F.col(low), F.col(total) - F.col(low)
    pick = F.col("first_lo") if forward else ~F.col("first_lo")
    return F.when(pick, lo).otherwise(hi)


def flow_id(key: str = "direction_key", first_seq: str = "first_seq") -> Column:
    """Content-derived flow identity: re-running a capture gives the same ids."""
    return F.sha2(F.concat(F.col(key), F.lit("#"), F.col(first_seq).cast("string")), 256)


def direction_label(forward: str = "forward_packet_count",
                    reverse: str = "reverse_packet_count") -> Column:
    """D4."""
    return (F.when(F.col(reverse) == 0, "forward").when(F.col(forward) == 0, "reverse")
             .otherwise("bidirectional"))


def finish_counters(grouped: DataFrame, *extra: Column) -> DataFrame:
    """D3: turns the orientation counters of a flow into forward/reverse ones."""
    grouped = grouped.withColumns({
        "first_seq": F.shiftright("first_coded", 1), "first_lo": F.col("first_coded") % 2 == 0,
        **{n: K.key_part("direction_key", n)
           for n in ("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol")}})

    def initiator(field: str, source: bool) -> Column:
        pick = F.col("first_lo") if source else ~F.col("first_lo")
        return F.when(pick, F.col(f"lo_{field}")).otherwise(F.col(f"hi_{field}"))

    out = grouped.select(
        flow_id().alias("flow_id"), *SEGMENT, "first_seq", "last_seq",
        initiator("ip", True).alias("src_ip"), initiator("ip", False).alias("dst_ip"),
        initiator("port", True).alias("src_port"), initiator("port", False).alias("dst_port"),
        "protocol",
        "start_time", "end_time", "first_fin_ts", (F.col("end_time") - F.col("start_time")).alias("duration_sec"),
        F.col("packets_all").alias("packet_count"), F.col("bytes_all").alias("byte_count"),
        F.col("payload_all").alias("payload_byte_count"),
        oriented("packets_lo", "packets_all", True).alias("forward_packet_count"),
        oriented("packets_lo", "packets_all", False).alias("reverse_packet_count"),
        oriented("bytes_lo", "bytes_all", True).alias("forward_bytes"),
        oriented("bytes_lo", "bytes_all", False).alias("reverse_bytes"),
        oriented("payload_lo", "payload_all", True).alias("forward_payload_bytes"),
        oriented("payload_lo", "payload_all", False).alias("reverse_payload_bytes"),
        *[f"{n}_count" for n in ("syn", "syn_ack", "ack", "fin", "rst", "psh")], *extra)
    return out.withColumns({
        "direction": direction_label(),
        "is_complete": (F.col("fin_count") > 0) | (F.col("rst_count") > 0),
    })


def flows(packets: DataFrame, params: FlowParams = FlowParams(),
          in_order: bool = False) -> DataFrame:
    """D1 + D3 + D4: one row per flow with counters and direction."""
    rows = flow_packets(packets, params, in_order)
    return finish_counters(rows.groupBy(*SEGMENT).agg(*counter_columns()))


def gap_sessions(packets: DataFrame, idle_sec: float) -> DataFrame:
    """Sessions by silence alone, with the built-in session window.

    ``session_window`` merges partial sessions before the shuffle, so a busy
    conversation arrives as few rows.
    """
    when = F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))
    return (packets.select(K.direction_key().alias("direction_key"), "ts", when.alias("event_time"))
            .groupBy("direction_key", F.session_window("event_time", f"{round(idle_sec * 1e6) - 1} microseconds"))
            .agg(F.count("*").alias("packet_count"), F.min("ts").alias("start_time"),
                 F.max("ts").alias("end_time"))
            .drop("session_window"))


def inter_arrivals(rows: DataFrame, params: FlowParams, in_order: bool = False) -> DataFrame:
    """Time-sorted gaps inside one flow and orientation, one row per gap.

    Gaps inside a time tile come from ``lag``; the gap between two tiles joins
    the last packet of one with the first of the next, from one row per tile.
    """
    group = [*SEGMENT, "lo_to_hi", "time_tile"]
    tile = F.col("tile") if in_order else tick(F.col("ts"), params.idle_sec)
    rows = rows.withColumn("time_tile", tile)
    local = Window.partitionBy(*group).orderBy("ts", "pkt_seq")
    inner = (rows.withColumn("iat", F.col("ts") - F.lag("ts").over(local))
             .filter("iat is not null").select(*SEGMENT, "lo_to_hi", "iat"))
    return inner.unionByName(border_gaps(rows, group))


def border_gaps(rows: DataFrame, group: list[str]) -> DataFrame:
    ends = rows.groupBy(*group).agg(F.min("ts").alias("head"), F.max("ts").alias("tail"))
    across = Window.partitionBy(*SEGMENT, "lo_to_hi").orderBy("time_tile")
    return (ends.withColumn("iat", F.col("head") - F.lag("tail").over(across))
            .filter("iat is not null").select(*SEGMENT, "lo_to_hi", "iat"))
