"""DNS evidence: pairing, windows, signals.

Messages carry ``pkt_seq ts src_ip dst_ip src_port dst_port protocol transaction_id
qr rcode status questions``, where questions is an array of (name, qtype, qclass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import keys as K
from quietwire.functions import lexical as X
from quietwire.operators.clock import as_of, tick
from quietwire.operators.signals import signal
from quietwire.operators.windows import changes, member_changes, values_at
from quietwire.schema import DnsParams

COUNTERS = ("query_messages", "response_messages", "nxdomain", "paired", "paired_nxdomain", "questions",
            "length_sum", "high_entropy", "long_labels", "long_queries", "txt")


def oriented(messages: DataFrame) -> DataFrame:
    """Who asked and who answered, whichever way the message travels."""
    qr = F.col("qr")

    def pick(answer: str, ask: str) -> Column:
        return F.when(qr, F.col(answer)).otherwise(F.col(ask))

    return messages.withColumns({
        "client": pick("dst_ip", "src_ip"), "server": pick("src_ip", "dst_ip"),
        "client_port": pick("dst_port", "src_port"), "server_port": pick("src_port", "dst_port")})


def paired_messages(messages: DataFrame, ttl: float = 10.0, tile_sec: float = 60.0) -> DataFrame:
    """Adds ``visibility`` (PAIRED, QUERY_ONLY, RESPONSE_ONLY) and ``paired_nx``.

    A message pairs with the one before it under the same key if the two differ in
    direction, lie within ``ttl`` and the earlier one is not used yet.  In arrival
    order a chain of alternating, timely messages therefore pairs at every even
    position.  Chains are numbered inside a time tile; position and chain start at
    the beginning of a tile are carried in from one row per (key, tile).
    """
    m = oriented(messages.filter("status = 'PARSED'"))
    signature = F.sha2(F.to_json(F.struct(
        "client", "server", "client_port", "server_port", "protocol", "transaction_id", "questions")), 256)
    m = m.withColumns({"pair_key": signature, "tile": tick(F.col("ts"), tile_sec), "has_question": F.size("questions") > 0})
    local = Window.partitionBy("pair_key", "tile").orderBy("pkt_seq")
    before = F.lag(F.struct("ts", "qr", "rcode")).over(local)

    def broken(prev: Column) -> Column:
        return (prev["qr"] == F.col("qr")) | (F.abs(F.col("ts") - prev["ts"]) > ttl)

    m = m.withColumns({"prev": before, "place": F.row_number().over(local)})
    m = m.withColumn("starts", F.when(F.col("prev").isNotNull() & broken(F.col("prev")), F.col("place")))
    state = F.struct("ts", "qr", "rcode")
    ends = m.groupBy("pair_key", "tile").agg(
        F.count("*").alias("n"), F.min_by(state, "pkt_seq").alias("head"), F.max_by(state, "pkt_seq").alias("tail"),
        F.max("starts").alias("last_start"))
    by_tile = Window.partitionBy("pair_key").orderBy("tile")
    earlier = by_tile.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"carried": F.lag("tail").over(by_tile), "offset": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    opens = F.col("carried").isNull() | (F.col("carried.qr") == F.col("head.qr")) | (
        F.abs(F.col("head.ts") - F.col("carried.ts")) > ttl)
    ends = ends.withColumn("first_start", F.when(opens, F.col("offset") + 1))
    top = F.greatest("first_start", F.col("last_start") + F.col("offset"))
    ends = ends.withColumn("start_before", F.coalesce("first_start", F.max(top).over(earlier)))
    m = m.join(ends.select("pair_key", "tile", "offset", "start_before", "carried"), ["pair_key", "tile"])
    through = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.max("starts").over(through) + F.col("offset"), F.col("start_before"))
    position = F.col("place") + F.col("offset") - start + 1
    paired = (position % 2 == 0) & F.col("has_question")
    previous_nx = F.coalesce(F.col("prev.rcode"), F.col("carried.rcode")) == 3
    out = m.withColumn("is_paired", paired).withColumns({
        "visibility": F.when(F.col("is_paired"), "PAIRED").when(F.col("qr"), "RESPONSE_ONLY").otherwise("QUERY_ONLY"),
        "paired_nx": F.col("is_paired") & F.when(F.col("qr"), F.col("rcode") == 3).otherwise(previous_nx)})
    return out.drop("pair_key", "tile", "prev", "place", "starts", "offset", "start_before", "carried", "has_question", "is_paired")


def question_rows(messages: DataFrame, p: DnsParams) -> DataFrame:
    """One row per class-1 question with its name statistics and rule marks."""
    keep = [c for c in messages.columns if c not in ("questions", "qname", "qtype")]
    q = (messages.select(*keep, F.posexplode("questions").alias("number", "q"))
         .select(*keep, "number", F.col("q.name").alias("name"), F.col("q.qtype").alias("qtype"), F.col("q.qclass").alias("qclass")))
    q = q.withColumn("s", X.name_statistics(F.col("name")))
    high = F.exists("s.label_statistics", lambda x: (x.length >= p.entropy_min_label) & (x.entropy >= p.entropy_bits))
    return q.withColumns({"parent": X.parent_name(F.col("name")), "high": high})


def scope_changes(messages: DataFrame, scope: list[str], p: DnsParams) -> DataFrame:
    """Window changes of every counter of a scope (client, server or client and parent).

    ``messages`` are paired messages.  A message counts once per scope; only
    questions of queries count as questions.
    """
    width, span = p.bucket_sec, p.span
    at = tick(F.col("ts"), width).alias("tick")
    questions = question_rows(messages, p).filter("qclass = 1")
    per_message = messages
    if "parent" in scope:
        first = Window.partitionBy("pkt_seq", "parent").orderBy("number")  # at most four questions
        per_message = questions.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    nx = F.col("qr") & (F.col("rcode") == 3)
    counted = per_message.groupBy(*scope, at).agg(
        F.count_if(~F.col("qr")).alias("query_messages"), F.count_if("qr").alias("response_messages"),
        F.count_if(nx).alias("nxdomain"), F.count_if(F.col("visibility") == "PAIRED").alias("paired"),
        F.count_if("paired_nx").alias("paired_nxdomain"))
    asked = questions.filter("not qr")
    asks = asked.groupBy(*scope, at).agg(
        F.count("*").alias("questions"), F.sum("s.qname_length").alias("length_sum"),
        F.count_if("high").alias("high_entropy"), F.count_if(F.col("s.longest_label") >= p.long_label).alias("long_labels"),
        F.count_if(F.col("s.qname_length") >= p.long_query).alias("long_queries"), F.count_if(F.col("qtype") == 16).alias("txt"))
    both = counted.unionByName(asks, allowMissingColumns=True).fillna(0, list(COUNTERS))
    out = changes(both.groupBy(*scope, "tick").agg(*[F.sum(c).alias(c) for c in COUNTERS]), scope, COUNTERS, span)
    for member in ("name",) if "parent" in scope else ("name", "parent"):
        times = asked.groupBy(*scope, member, at).agg(F.count("*").alias("n"))
        out = out.unionByName(member_changes(times, scope, member, span, member), allowMissingColumns=True)
    return out


def scope_windows(messages: DataFrame, points: DataFrame, scope: list[str], p: DnsParams) -> DataFrame:
    """D20 at (scope, tick) points: rates, distinct names, ratios."""
    values = [*COUNTERS, "name_distinct", *([] if "parent" in scope else ["parent_distinct"])]
    at = values_at(scope_changes(messages, scope, p), points, scope, values)
    c = F.col
    n, responses = c("questions"), c("response_messages")

    def over(part: str) -> Column:
        return c(part) / F.greatest(n, F.lit(1))

    renamed = {"unique_domains": c("name_distinct"), "repeated_questions": n - c("name_distinct"),
               "query_rate": c("query_messages") / float(p.window_sec),
               "high_entropy_ratio": over("high_entropy"), "long_label_ratio": over("long_labels"),
               "long_query_ratio": over("long_queries"), "txt_ratio": over("txt"),
               "mean_query_length": F.try_divide(c("length_sum").cast("double"), n.cast("double")),
               "nxdomain_ratio": F.try_divide(c("nxdomain").cast("double"), responses.cast("double")),
               "paired_nxdomain_ratio": F.try_divide(c("paired_nxdomain").cast("double"), c("paired").cast("double"))}
    if "parent" not in scope:
        renamed["unique_parents"] = c("parent_distinct")
    return at.withColumns(renamed)


def type_counts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Questions per key and type, with the type name."""
    q = messages.filter("not qr").select(*keys, F.explode("questions").alias("q"))
    counted = q.groupBy(*keys, F.col("q.qtype").alias("qtype")).agg(F.count("*").alias("n"))
    return counted.withColumn("qtype_name", K.dns_type_name(F.col("qtype")))


def status_counts(messages: DataFrame) -> DataFrame:
    """D59."""
    return messages.groupBy("status").agg(F.count("*").alias("messages"))


def latest_in_flow(flow: DataFrame, messages: DataFrame, enabled: bool = True, width: float = 3600.0) -> DataFrame:
    """Each flow with the newest message of its conversation inside the flow.

    That is the last message up to the flow's end, if it does not lie before its start; later arrivals win ties. ``enabled=False`` says that
    messages are not looked at.
    """
    if not enabled:
        return flow.withColumn("dns_status", F.lit("disabled"))
    m = messages.withColumn("direction_key", K.direction_key())
    whole = F.struct(*[c for c in m.columns if c != "direction_key"])
    out = as_of(flow, m, ["direction_key"], "end_time", "ts", "pkt_seq", whole, width, "m")
    out = out.withColumn("m", F.when(F.col("m.ts") >= F.col("start_time"), F.col("m")))
    return out.withColumn("dns_status", F.coalesce(F.col("m.status"), F.lit("unavailable_or_not_observed")))


def question_signals(observed: DataFrame, p: DnsParams) -> DataFrame:
    """Rules on the names of the observed message."""
    rows = observed.filter("dns_status = 'PARSED'").select("flow_id", F.explode("m.questions").alias("q"))
    rows = rows.withColumn("s", X.name_statistics(F.col("q.name")))
    c = F.col
    long = c("s.longest_label") >= p.long_label
    strong = F.array_max(F.transform(F.filter("s.label_statistics", lambda x: x.length >= p.entropy_min_label), lambda x: x.entropy))
    context = {"domain": c("q.name")}
    rules = [
        signal("DNS_LEXICAL_ANOMALY", "dns_intelligence", c("s.longest_label"), p.long_label, "label characters", long, context),
        signal("DNS_LEXICAL_ANOMALY", "dns_intelligence", c("s.qname_length"), p.long_query, "QNAME characters",
               ~long & (c("s.qname_length") >= p.long_query), context),
        signal("DNS_HIGH_ENTROPY_LABEL", "dns_intelligence", strong, p.entropy_bits, "bits/character",
               F.coalesce(strong >= p.entropy_bits, F.lit(False)), context)]
    return rows.withColumn("rules", F.array_compact(F.array(*rules))).select("flow_id", F.inline("rules"))


def window_signals(observed: DataFrame, messages: DataFrame, p: DnsParams) -> DataFrame:
    """I15-I19 for flows with an observed message; ``observed`` carries ``eval_tick``."""
    seen = observed.filter("dns_status = 'PARSED'")
    first = F.filter("m.questions", lambda q: q.qclass == 1)
    seen = seen.select("flow_id", F.col("eval_tick").alias("tick"), F.col("m.client").alias("client"),
                       X.parent_name(F.try_element_at(first, F.lit(-1)).getField("name")).alias("parent"))
    c = F.col
    source = seen.join(scope_windows(messages, seen, ["client"], p), ["client", "tick"])
    failed = F.coalesce((c("paired") >= p.min_responses) & (c("paired_nxdomain_ratio") >= p.nxdomain_ratio), F.lit(False))
    context = {"questions": c("questions"), "unique_domains": c("unique_domains")}
    rules = [
        signal("DNS_UNIQUE_DOMAIN_RATE", "dns_intelligence", c("unique_domains") / float(p.window_sec),
               p.unique_domains / p.window_sec, "distinct queried names/second", c("unique_domains") >= p.unique_domains, context),
        signal("DNS_NXDOMAIN_PATTERN", "dns_intelligence", c("nxdomain_ratio"), p.nxdomain_ratio, "observed response fraction",
               (c("response_messages") >= p.min_responses) & F.coalesce(c("nxdomain_ratio") >= p.nxdomain_ratio, F.lit(False)), context),
        signal("DNS_QTYPE_PATTERN", "dns_intelligence", c("txt_ratio"), p.txt_ratio, "TXT question fraction",
               (c("questions") >= p.min_queries) & (c("txt_ratio") >= p.txt_ratio), context),
        signal("DGA_LIKE_BEHAVIOR", "dns_intelligence", c("high_entropy_ratio"), p.high_entropy_ratio, "high-entropy question fraction",
               (c("questions") >= p.min_queries) & (c("unique_parents") >= p.unique_domains)
               & (c("high_entropy_ratio") >= p.high_entropy_ratio) & (failed | (c("long_label_ratio") >= p.long_label_ratio)), context)]
    one = source.withColumn("rules", F.array_compact(F.array(*rules))).select("flow_id", F.inline("rules"))
    named = seen.filter("parent is not null")
    parent = named.join(scope_windows(messages, named, ["client", "parent"], p), ["client", "parent", "tick"])
    tunnel = signal(
        "DNS_TUNNELLING_LIKE_BEHAVIOR", "dns_intelligence", c("unique_domains"), p.unique_subdomains, "distinct names under parent proxy",
        (c("questions") >= p.min_queries) & (c("unique_domains") >= p.unique_subdomains)
        & (c("high_entropy_ratio") >= p.high_entropy_ratio) & (c("long_label_ratio") >= p.long_label_ratio)
        & (c("questions") / float(p.window_sec) >= p.query_rate), {**context, "parent": c("parent")})
    two = parent.withColumn("rules", F.array_compact(F.array(tunnel))).select("flow_id", F.inline("rules"))
    return one.unionByName(two)


def technique_context(signals: DataFrame) -> DataFrame:
    """The DNS technique is cited only next to a tunnelling signal."""
    spark = signals.sparkSession
    table = spark.createDataFrame(list(S.TECHNIQUES), S.TECHNIQUE_SCHEMA).filter("technique_id = 'T1071.004'")
    hit = signals.filter("signal_type = 'DNS_TUNNELLING_LIKE_BEHAVIOR'").select("flow_id", F.lit("dns_tunneling").alias("threat_type")).distinct()
    return hit.join(F.broadcast(table), "threat_type").select(
        "flow_id", "technique_id", "technique_name", F.lit("possible").alias("qualification"))

