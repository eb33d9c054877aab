"""Stored flows and detection events: records, listings, counts, retention
(A9, A12, A16, A17, B34, B35, C1, C2, C4, D21-D24, F1-F3, F6-F8, F11)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.functions.numbers import is_number
from quietwire.operators.clock import prefix_sums, rows_at_ranks, tick, with_scalars

EVENT_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
MAX_EVENTS = 32
HORIZON_SEC = 300.0


def event_records(events: DataFrame) -> DataFrame:
    """The public record of a stored row.

    Fields that older rows keep inside the metadata JSON are lifted to columns;
    a status that was never recorded reads ``not_recorded``.  Unreadable JSON
    counts as empty.
    """
    meta = F.col("metadata")

    def lifted(name: str, path: str) -> Column:
        found = F.get_json_object(meta, path)
        return (F.coalesce(F.col(name), found) if name in events.columns else found).alias(name)

    kept = [c for c in events.columns if c not in
            ("model_name", "deployment_model_version", "source_mode", "capture_interface",
             "replay_file_identifier", "dns_status", "tls_status", "quic_status")]
    return events.select(
        *kept, F.col("event_id").alias("id"), F.col("threat_type").alias("threat_class"),
        lifted("model_name", "$.deployment_model.model_name"),
        lifted("deployment_model_version", "$.deployment_model.model_version"),
        lifted("source_mode", "$.source.source_mode"),
        lifted("capture_interface", "$.source.capture_interface"),
        lifted("replay_file_identifier", "$.source.replay_file_identifier"),
        *[F.coalesce(F.get_json_object(meta, f"$.{n}"), F.lit("not_recorded")).alias(n)
          for n in ("dns_status", "tls_status", "quic_status")])


def detection_source(*parts: tuple[Column, str]) -> Column:
    """Names of the detectors whose condition holds, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in parts])))


def validity(events: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (null for a valid row) and ``is_valid``."""
    def port_ok(name: str, top: int) -> Column:
        return F.col(name).isNull() | F.col(name).between(0, top)

    reason = (F.when(~F.coalesce(F.col("event_id").rlike(EVENT_ID), F.lit(False)), "identity")
               .when(~is_number(F.col("timestamp")), "time")
               .when(F.col("anomaly_score").isNotNull() & ~is_number(F.col("anomaly_score")), "score")
               .when(~port_ok("src_port", 65535) | ~port_ok("dst_port", 65535)
                     | ~port_ok("protocol", 255), "endpoint"))
    return events.withColumn("reject_reason", reason).withColumn("is_valid", reason.isNull())


def with_flow(events: DataFrame, flow: DataFrame) -> DataFrame:
    """Events with the endpoints of their flow; events without one are kept."""
    ends = flow.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    bare = events.drop("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    return bare.join(ends.hint("merge"), "flow_id", "left")


def narrowed(events: DataFrame, since: float | None = None, threat_type: str | None = None,
             severity: str | None = None, flow_id: str | None = None) -> DataFrame:
    """The optional predicates, joined by AND."""
    out = events if since is None else events.filter(F.col("timestamp") >= F.lit(since))
    for name, value in (("threat_type", threat_type), ("severity", severity), ("flow_id", flow_id)):
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    return out


def page(rows: DataFrame, ts: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """newest first, ties by id; one page."""
    return rows.orderBy(F.col(ts).desc(), F.col(tie)).offset(offset).limit(limit)


def list_flows(flow: DataFrame, limit: int = 50, offset: int = 0, since: float | None = None) -> DataFrame:
    rows = flow if since is None else flow.filter(F.col("start_time") >= F.lit(since))
    return page(rows, "start_time", "flow_id", limit, offset)


def list_events(events: DataFrame, flow: DataFrame, limit: int = 50, offset: int = 0, **where) -> DataFrame:
    """the page is cut first, so only its rows are joined to their flows."""
    wanted = page(narrowed(events, **where), "timestamp", "event_id", limit, offset)
    return with_flow(wanted, flow)


def event_stats(events: DataFrame) -> DataFrame:
    """Counts by threat type, by severity and in total, in one pass."""
    return (events.groupingSets([["threat_type"], ["severity"], []], "threat_type", "severity")
            .agg(F.count("*").alias("events"), F.grouping_id().alias("grouping")))


def share_of_top(counts: DataFrame, value: str) -> DataFrame:
    """Each count as a percentage of the largest.  ``counts`` is a small report."""
    return counts.withColumn("percent_of_top", F.col(value) * 100.0 / F.max(value).over(Window.partitionBy(F.lit(0))))


def orphan_flows(flow: DataFrame, events: DataFrame) -> DataFrame:
    """C4: flows that no event refers to."""
    return flow.join(events.select("flow_id"), "flow_id", "left_anti")


def unseen_rows(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def live_feed(events: DataFrame, size: int = 100) -> DataFrame:
    """The newest ``size`` distinct events."""
    return events.dropDuplicates(["event_id"]).orderBy(F.col("timestamp").desc(), "event_id").limit(size)


def oldest_beyond(events: DataFrame, max_count: int, bucket_sec: float = 3600.0) -> DataFrame:
    """the oldest rows in excess of ``max_count``.

    Row counts per time bucket find the bucket where the cut falls; only that one
    is ordered, all other rows are compared with the cut.
    """
    cut = rows_at_ranks(events, tick(F.col("timestamp"), bucket_sec), ["timestamp", "event_id"], {"_cut": F.col("n") - F.lit(max_count)})
    return with_scalars(events, cut).filter(F.struct("timestamp", "event_id") <= F.col("_cut")).drop("_cut")


def older_than(events: DataFrame, cutoff: float) -> DataFrame:
    """F7."""
    return events.filter(F.col("timestamp") < F.lit(cutoff))


def retention_batch(events: DataFrame, flow: DataFrame, max_count: int, cutoff: float,
                    row_limit: int) -> tuple[DataFrame, DataFrame]:
    """F8: events and flows one bounded clean-up run removes.

    Of the first ``row_limit/2`` events in (timestamp, id) order those in excess
    or older than ``cutoff`` go; the rest of the budget takes flows whose events
    are all gone and that had one.
    """
    first = events.orderBy("timestamp", "event_id").limit(max(1, row_limit // 2))
    placed = Window.partitionBy(F.lit(0)).orderBy("timestamp", "event_id")  # at most row_limit/2 rows
    total = events.agg(F.count("*").alias("total"))
    excess = F.greatest(F.col("total") - F.lit(max_count), F.lit(0))
    victims = (with_scalars(first.withColumn("place", F.row_number().over(placed)), total)
               .filter((F.col("place") <= excess) | (F.col("timestamp") < F.lit(cutoff)))
               .select("event_id", "flow_id", "timestamp"))
    left = events.join(victims.select("event_id"), "event_id", "left_anti")
    eligible = flow.join(events.select("flow_id"), "flow_id", "left_semi")
    budget = victims.agg((F.lit(row_limit) - F.count("*")).alias("budget"))
    gone = orphan_flows(eligible, left).select("flow_id").orderBy("flow_id").limit(row_limit)
    gone = gone.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("flow_id")))
    gone = with_scalars(gone, budget).filter("place <= budget").select("flow_id")
    return victims, gone


def ranges(rows: DataFrame, keys: list[str], horizon: float, sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``position`` along (timestamp, event_id) of their key, ``low`` and ``high``, the positions before and of the last row within ``horizon``
    seconds around them, and of every sum its total within that range.

    Each row and two narrow probes are ordered inside tiles of the horizon; what earlier tiles hold is carried in.
    """
    narrow = rows.select(*keys, "event_id", "timestamp", *[c.cast("long").alias(n) for n, c in sums.items()])
    probe = F.inline(F.array(*[F.struct((F.col("timestamp") + shift).alias("at"), F.lit(kind).alias("kind")) for shift, kind in ((-horizon, 0), (0.0, 1), (horizon, 2))]))
    both = narrow.select("*", probe).withColumn("tile", tick(F.col("at"), horizon))
    counted = {n: F.when(F.col("kind") == 1, c).otherwise(F.lit(0)) for n, c in {"_position": F.lit(1).cast("long"), **{f"_{n}": F.col(n) for n in sums}}.items()}
    placed = prefix_sums(both, "tile", ["at", "kind", "event_id"], counted, keys)
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return placed.groupBy(*keys, "event_id", "timestamp").agg(
        at(1, "_position").alias("position"), at(0, "_position").alias("low"), at(2, "_position").alias("high"),
        *[(at(2, f"_{n}") - at(0, f"_{n}")).alias(n) for n in sums])


def neighbourhoods(events: DataFrame, horizon: float = HORIZON_SEC, limit: int = MAX_EVENTS) -> DataFrame:
    """For every event the events of its flow within ``horizon`` seconds.

    The anchor comes first, then its neighbours in (timestamp, id) order up to ``limit`` rows; ``found`` counts all of them and ``truncated`` tells whether
    there were more. Events are filed in blocks of ``limit`` neighbouring positions, and what an anchor lists stands in two blocks at most, so that two
    rows move for each event, however many events a flow has.
    """
    placed = ranges(events, ["flow_id"], horizon, {})
    block = F.floor(F.col("position") / limit)
    blocks = placed.groupBy("flow_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "event_id", "timestamp"))).alias("held"))
    wanted = placed.withColumn("block", F.explode(F.sequence(F.floor((F.col("low") + 1) / limit), F.floor(F.least(F.col("low") + limit, F.col("high")) / limit))))
    inside = F.filter("held", lambda h: (h["position"] > F.col("low")) & (h["position"] <= F.least(F.col("low") + limit, F.col("high"))))
    near = wanted.join(blocks.hint("merge"), ["flow_id", "block"]).groupBy("flow_id", "event_id", "timestamp", "position", "low", "high").agg(
        F.array_sort(F.flatten(F.collect_list(inside))).alias("near"))
    others = F.filter("near", lambda h: h["position"] != F.col("position"))
    own = F.array(F.struct("position", "event_id", "timestamp"))
    listed = near.select("flow_id", F.col("event_id").alias("anchor_id"), F.col("timestamp").alias("anchor_ts"), (F.col("high") - F.col("low")).alias("found"),
                         F.posexplode(F.slice(F.concat(own, others), 1, limit)).alias("place", "other"))
    # an event without a flow has no neighbours
    alone = events.filter("flow_id is null").select("flow_id", F.col("event_id").alias("anchor_id"), F.col("timestamp").alias("anchor_ts"), F.lit(1).cast("long").alias("found"),
                                                    F.lit(0).alias("place"), F.struct(F.lit(1).cast("long").alias("position"), "event_id", "timestamp").alias("other"))
    listed = listed.unionByName(alone)
    return listed.select("anchor_id", "anchor_ts", "flow_id", F.col("other.event_id").alias("other_id"), F.col("other.timestamp").alias("other_ts"),
                         (F.col("place") + 1).alias("place"), "found", (F.col("found") > limit).alias("truncated"))


def technique_rollup(events: DataFrame, techniques: DataFrame, newest: int = 50) -> DataFrame:
    """Techniques of the newest events, most frequent first, with what was seen last."""
    recent = events.orderBy(F.col("timestamp").desc(), "event_id").limit(newest)
    hit = recent.join(F.broadcast(techniques), "threat_type")
    return (hit.groupBy("technique_id").agg(
        F.count("*").alias("events"), F.min("technique_name").alias("technique_name"),
        F.min("tactic").alias("tactic"), F.max("timestamp").alias("last_seen"))
        .orderBy(F.col("events").desc(), "technique_id"))


def latest_per_key(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key; the cut to one row happens before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")


def latency_percentiles(rows: DataFrame, stage: str, value: str, ts: str, tie: str,
                        newest: int = 4096) -> DataFrame:
    """p50, p95, p99 (linear interpolation) of the newest samples of each stage."""
    recent = Window.partitionBy(stage).orderBy(F.col(ts).desc(), F.col(tie).desc())
    kept = rows.withColumn("_place", F.row_number().over(recent)).filter(F.col("_place") <= newest)
    q = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return kept.groupBy(stage).agg(F.count("*").alias("samples"), q.alias("q")).select(
        stage, "samples", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def health_reasons(counters: DataFrame, names: list[str]) -> DataFrame:
    """Names of the counters that are not zero, per row."""
    marks = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in names]))
    return counters.withColumn("reasons", F.array_sort(marks))
