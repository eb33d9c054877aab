"""Queries over feature rows: preparation, explanation, error analysis, foreign tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.functions import numbers as N
from quietwire.operators import detect as D
from quietwire.operators import features as FE
from quietwire.operators import splits as L
from quietwire.plans import bindings as B
from quietwire.plans.registry import query, rounded

SOME = ("duration_sec", "total_packets", "pkt_size_mean", "iat_mean", "rev_iat_std", "payload_ratio")
GAPPY = "iat_mean"  # set to missing on every seventh row, so that imputation has work to do

V = B.SQL_VIEWS
V["gappy"] = (("features",), "select * replace (case when first_seq%7=0 then null else iat_mean end as iat_mean) from features")
V["long"] = (("gappy",), " union all ".join(f"select first_seq, '{c}' as feature, {c} as value from gappy" for c in SOME))
V["imputed"] = (("long",), "select first_seq, feature, coalesce(value, median(value) over (partition by feature)) as value from long")
V["all_long"] = (("features",), " union all ".join(f"select flow_id, first_seq, '{c}' as feature, {c} as value from features" for c in S.FEATURES))
V["stats"] = (("all_long",), "select feature, avg(value) as mean, case when stddev_pop(value) < 1e-10 then 1.0 else stddev_pop(value) end as std from all_long group by all")
V["zs"] = (("all_long", "stats"), "select *, abs((value-mean)/std) as z from all_long join stats using (feature)")
V["pred_rows"] = (("features",), "select *, (['benign','ddos','c2','other','unknown'])[first_seq%4+1] as pred from features")
V["fails"] = (("pred_rows", "zs"), """
select p.flow_id, label, pred, case when label='benign' and pred<>'benign' then 'false_positive' else 'false_negative' end as failure_type,
 abs(anomaly_score-0.5) < 0.1 as f3, (select count(*) from features x where x.label=p.label)/(select count(*) from features) < 0.05 as f6,
 n3 > 3 or zmax > 5 as f7, abs(reverse_packets)+abs(reverse_bytes)+abs(rev_iat_mean)+abs(rev_iat_std)+abs(rev_iat_min)+abs(rev_iat_max)+abs(reverse_payload_bytes) <= 1e-10
   and not (label='benign' and pred<>'benign') as f2, total_packets < 3 as f9, label in ('other','unknown') as f8
from pred_rows p join (select flow_id, count(*) filter (z>3) as n3, max(z) as zmax from zs group by all) using (flow_id) where label<>pred""")


def gappy(spark, sf):
    return B.stored_features(spark, sf).withColumn(GAPPY, F.when(F.col("first_seq") % 7 == 0, float("inf")).otherwise(F.col(GAPPY)))


def predicted(spark, sf):
    names = F.array(*[F.lit(x) for x in ("benign", "ddos", "c2", "other", "unknown")])
    return B.stored_features(spark, sf).withColumn("pred", F.element_at(names, (F.col("first_seq") % 4 + 1).cast("int")))


@query("feature_medians", B.with_views("select feature, round(median(value),6)+0.0 as median from long group by feature", "long"))
def feature_medians(spark, sf):
    """K2, K3."""
    return rounded(D.medians(D.finite(gappy(spark, sf), SOME), SOME))


@query("scaling_statistics", B.with_views("""
select feature, round(median(value),6)+0.0 as median, round(avg(value),6)+0.0 as mean, round(stddev_pop(value),6)+0.0 as std from imputed group by feature""", "imputed"))
def scaling_statistics(spark, sf):
    """K3, K4."""
    return rounded(D.scaling_statistics(gappy(spark, sf), SOME).select("feature", "median", "mean", "std"))


@query("standardised_rows", B.with_views("""
select first_seq, """ + ", ".join(f"round(max(z) filter (feature='{c}'),5)+0.0 as {c}" for c in SOME) + """ from (
 select first_seq, feature, (value - avg(value) over (partition by feature))/stddev_pop(value) over (partition by feature) as z from imputed) group by first_seq""", "imputed"))
def standardised_rows(spark, sf):
    """K4, K5."""
    rows = gappy(spark, sf)
    return rounded(D.standardise(rows, D.scaling_statistics(rows, SOME), SOME).select("first_seq", *SOME), 5)


@query("missing_features", B.with_views("""
select feature, round(1-count(value)/count(*),6)+0.0 as missing_share, count(value)=0 as all_missing, coalesce(var_pop(value)<1e-8,false) as constant from (
 select feature, value from all_long where feature in ('ip_version','is_icmp','duration_sec') union all select feature, value from long where feature='iat_mean'
 union all select 'pkt_size_p25', null from features) group by feature""", "all_long", "long"))
def missing_features(spark, sf):
    """D48, D58."""
    rows = gappy(spark, sf).withColumn("pkt_size_p25", F.lit(None).cast("double"))
    return rounded(D.missing_report(rows, ["ip_version", "is_icmp", "duration_sec", "iat_mean", "pkt_size_p25"]))


@query("training_statistics", B.with_views("select feature, round(mean,4)+0.0 as mean, round(std,4)+0.0 as std from stats", "stats"))
def training_statistics(spark, sf):
    """D47."""
    return rounded(D.training_statistics(B.stored_features(spark, sf)), 4)


@query("feature_evidence", B.with_views("""
select flow_id, string_agg(feature, ';' order by round(z,9) desc, feature) as evidence, count(*) as items, round(max(z),4)+0.0 as strongest from zs where z >= 2 group by flow_id""", "zs"))
def feature_evidence(spark, sf):
    """H1, F5."""
    rows = B.stored_features(spark, sf)
    out = D.with_evidence(rows, D.training_statistics(rows)).filter(F.size("evidence") > 0)
    return rounded(out.select("flow_id", F.array_join(F.transform("evidence", lambda e: e.feature_name), ";").alias("evidence"),
                              F.size("evidence").cast("long").alias("items"), F.col("evidence")[0].contribution.alias("strongest")), 4)


@query("explanations", B.with_views("""
select explanation_available, unavailable_reason, count(*) as flows, sum(items)::bigint as items from (
 select f.first_seq%2=0 as explanation_available, case when f.first_seq%2<>0 then 'Training baseline not supplied to anomaly explainer.' end as unavailable_reason,
  case when f.first_seq%2=0 then (select count(*) from zs z where z.flow_id=f.flow_id and z.z>=2) end as items from features f) group by all""", "features", "zs"))
def explanations(spark, sf):
    """H9."""
    rows = B.stored_features(spark, sf)
    e = D.with_evidence(rows, D.training_statistics(rows)).withColumn("x", D.explanation(F.col("evidence"), F.col("first_seq") % 2 == 0))
    return e.groupBy("x.explanation_available", "x.unavailable_reason").agg(F.count("*").alias("flows"), F.sum(F.size("x.items")).alias("items"))


@query("false_positive_deviations", B.with_views("""
select flow_id, string_agg(feature, ';' order by round(z,9) desc, feature) as top from (select *, row_number() over (partition by flow_id order by round(z,9) desc, feature) as rn from zs
 where flow_id in (select flow_id from pred_rows where label='benign' and pred<>'benign')) where rn <= 5 group by flow_id""", "zs", "pred_rows"))
def false_positive_deviations(spark, sf):
    """Every false alarm and the five features that stand out most."""
    rows = predicted(spark, sf)
    alarms = rows.filter((F.col("label") == "benign") & (F.col("pred") != "benign"))
    return D.top_deviations(alarms, D.training_statistics(rows)).select(
        "flow_id", F.array_join(F.transform("top", lambda e: e.feature_name), ";").alias("top"))


def _failures(spark, sf):
    rows = predicted(spark, sf)
    total = rows.agg(F.count("*").alias("all"))
    from quietwire.operators.clock import with_scalars

    share = with_scalars(rows.groupBy("label").agg(F.count("*").alias("n")), total).select("label", (F.col("n") / F.col("all")).alias("share"))
    return D.failure_codes(rows, D.training_statistics(rows), share)


@query("failure_codes", B.with_views("""
select flow_id, failure_type, coalesce(nullif(concat_ws(';', case when f3 then 'F3' end, case when f6 then 'F6' end, case when f7 then 'F7' end, case when f2 then 'F2' end,
 case when f9 then 'F9' end, case when f8 then 'F8' end),''),'F1') as codes from fails""", "fails"))
def failure_codes(spark, sf):
    """H2."""
    return _failures(spark, sf).select("flow_id", "failure_type", F.array_join("codes", ";").alias("codes"))


@query("failure_counts", B.with_views("""
select code, case code when 'F1' then count(*) filter (not(f2 or f3 or f6 or f7 or f8 or f9)) when 'F2' then count(*) filter (f2) when 'F3' then count(*) filter (f3)
 when 'F6' then count(*) filter (f6) when 'F7' then count(*) filter (f7) when 'F8' then count(*) filter (f8) when 'F9' then count(*) filter (f9) else 0 end as n
from fails, (select unnest(['F1','F2','F3','F4','F5','F6','F7','F8','F9','F10']) as code) group by code""", "fails"))
def failure_counts(spark, sf):
    """D46."""
    return D.failure_counts(_failures(spark, sf)).select("code", "n")


@query("feature_categories", B.with_views("""
select category, count(*) as features, round(sum(total),2)+0.0 as total from (select case when starts_with(feature,'pkt_size_') then 'packet_size_stats'
 when regexp_matches(feature,'^(iat_|fwd_iat_|rev_iat_)') then 'inter_arrival_time' when regexp_matches(feature,'^(syn_|ack_|fin_|rst_|psh_)') then 'tcp_flags'
 when feature in ('protocol','ip_version','is_tcp','is_udp','is_icmp') then 'protocol' when feature in ('payload_bytes_total','forward_payload_bytes','reverse_payload_bytes','payload_ratio') then 'payload_metadata'
 when regexp_matches(feature,'^(forward_|reverse_|fwd_rev_)') then 'directional' else 'basic' end as category, feature, sum(value) as total from all_long group by all) group by category""", "all_long"))
def feature_categories(spark, sf):
    """The feature catalogue joined with what the flows hold per category."""
    sums = D.long_form(B.stored_features(spark, sf), S.FEATURES).groupBy("feature").agg(F.sum("value").alias("total"))
    return FE.feature_catalogue(spark).join(sums, "feature").groupBy("category").agg(
        F.count("*").alias("features"), F.round(F.sum("total"), 2).alias("total"))


@query("feature_record_check", B.with_views("select first_seq%9<>0 as valid, count(*) as flows from features group by all", "features"))
def feature_record_check(spark, sf):
    """Every ninth record has a value changed after its map was built."""
    names = F.array(*[F.lit(f) for f in S.FEATURES])
    values = F.array(*[F.col(f) for f in S.FEATURES])
    changed = F.when(F.col("first_seq") % 9 == 0, F.transform(values, lambda v: v + 1)).otherwise(values)
    rows = B.stored_features(spark, sf).select("first_seq", names.alias("names"), changed.alias("values"),
                                               F.map_from_arrays(names, values).alias("features"))
    return rows.groupBy(FE.features_valid().alias("valid")).agg(F.count("*").alias("flows"))


@query("duplicate_feature_rows", B.with_views("""
select copies, count(*) as row_kinds from (select count(*) as copies from features group by """ + ", ".join(SOME[:4]) + """) group by copies""", "features"))
def duplicate_feature_rows(spark, sf):
    """How often the same row identity occurs."""
    rows = B.stored_features(spark, sf).groupBy(N.row_hash(SOME[:4]).alias("identity")).agg(F.count("*").alias("copies"))
    return rows.groupBy("copies").agg(F.count("*").alias("row_kinds"))


@query("one_directional_rows", B.with_views("""
select label, round(sum(reverse_bytes),2)+0.0 as before, 0.0::double as after, round(sum(forward_bytes),2)+0.0 as kept from features group by label""", "features"))
def one_directional_rows(spark, sf):
    """K23."""
    rows = B.stored_features(spark, sf)
    before = rows.groupBy("label").agg(F.round(F.sum("reverse_bytes"), 2).alias("before"))
    cut = D.one_directional(rows).groupBy("label").agg(F.sum("reverse_bytes").alias("after"), F.round(F.sum("forward_bytes"), 2).alias("kept"))
    return before.join(cut, "label")


@query("missing_as_zero", B.with_views("select label, round(sum(coalesce(iat_mean,0)),2)+0.0 as total, count(*) filter (iat_mean is null) as filled from gappy group by label", "gappy"))
def missing_as_zero(spark, sf):
    """K18."""
    rows = gappy(spark, sf).withColumn("was_missing", F.col("first_seq") % 7 == 0)
    return D.missing_as_zero(rows, SOME).groupBy("label").agg(F.round(F.sum(GAPPY), 2).alias("total"), F.count_if("was_missing").alias("filled"))


def _noisy_sql(column: str) -> str:
    """What ``noisy_features`` does to a column, in SQL."""
    u = lambda seed: f"((('0x'||substr(md5(flow_id||':{column}:{seed}'),1,13))::bigint + 0.5::double) / 4503599627370496.0::double)"
    normal = f"sqrt(-2.0*ln({u(42)}))*cos({u(42 + 7919)}*6.283185307179586::double)*0.1::double"
    value = (f"{column} + {normal}" if column in D.IAT_FEATURES else f"greatest({column} + {normal}, 0.0)" if column in D.SIZE_FEATURES
             else f"{column}*(1+({u(42)}*2-1)*0.2::double)" if column == "duration_sec" else column)
    return f"round(avg(case when {u(42)} < 0.1::double then 0.0 else {value} end),4)+0.0 as {column}"


@query("noisy_features", B.with_views("select label, " + ", ".join(_noisy_sql(c) for c in SOME) + " from features group by label", "features"))
def noisy_features(spark, sf):
    """Perturbed rows; the noise is fixed by row and seed."""
    rows = B.stored_features(spark, sf)
    noisy = D.random_drop(D.duration_scaling(D.size_noise(D.timing_jitter(rows, "flow_id"), "flow_id"), "flow_id"), "flow_id", 0.1)
    return rounded(noisy.groupBy("label").agg(*[F.avg(c).alias(c) for c in SOME]), 4)


def _as_cic(flows):
    """Feature rows under the column names of the CIC flow tables (times in microseconds)."""
    d, us = F.col, lambda c: F.col(c) * 1e6
    names = {
        "Flow Duration": us("duration_sec"), "Total Fwd Packets": d("forward_packets"), "Total Backward Packets": d("reverse_packets"),
        "Fwd Packets Length Total": d("forward_bytes"), "Bwd Packets Length Total": d("reverse_bytes"),
        "Flow Packets/s": d("packets_per_sec"), "Flow Bytes/s": d("bytes_per_sec"), "Protocol": d("protocol"),
        "Label": F.when(d("label") == "benign", "BENIGN").when(d("label") == "ddos", "DoS Hulk").when(d("label") == "c2", "Bot").otherwise("Odd")}
    for stat in ("Mean", "Std", "Min", "Max"):
        names[f"Packet Length {stat}"] = d(f"pkt_size_{stat.lower()}")
        for ours, theirs in (("iat", "Flow"), ("fwd_iat", "Fwd"), ("rev_iat", "Bwd")):
            names[f"{theirs} IAT {stat}"] = us(f"{ours}_{stat.lower()}")
    for flag in ("SYN", "ACK", "FIN", "RST", "PSH"):
        names[f"{flag} Flag Count"] = d(f"{flag.lower()}_count")
    return flows.select("flow_id", *[c.alias(n) for n, c in names.items()])


@query("cic_projection", B.with_views("""
select flow_id, case label when 'benign' then 'benign' when 'ddos' then 'ddos' when 'c2' then 'c2' else 'unknown' end as label, round(duration_sec,4)+0.0 as duration_sec, total_packets,
 round(forward_packets/greatest(reverse_packets,1),6)+0.0 as fwd_rev_packet_ratio, round(syn_ratio,6)+0.0 as syn_ratio, is_tcp, null::double as pkt_size_median from features""", "features"))
def cic_projection(spark, sf):
    """B8, B9, B10, B13."""
    rows = _as_cic(B.stored_features(spark, sf))
    out = D.mapped(rows, D.cic_features(), F.col("flow_id"), D.canonical_label(F.col("Label"), S.CIC_LABELS).alias("label"))
    return rounded(out.select("flow_id", "label", F.round("duration_sec", 4).alias("duration_sec"), "total_packets", "fwd_rev_packet_ratio", "syn_ratio", "is_tcp", "pkt_size_median"))


@query("unsw_projection", B.with_views("""
select flow_id, case when first_seq%3=0 then (case when first_seq%2=0 then 'benign' else 'other' end) when first_seq%3=1 then 'c2' else 'reconnaissance' end as label,
 total_packets, round(total_packets/greatest(duration_sec,1e-6),2)+0.0 as packets_per_sec, round(forward_bytes/greatest(reverse_bytes,1),6)+0.0 as fwd_rev_byte_ratio,
 protocol, is_udp, null::double as iat_mean from features""", "features"))
def unsw_projection(spark, sf):
    """B11, B13, B14."""
    n = F.col("first_seq")
    rows = B.stored_features(spark, sf).select(
        "flow_id", F.col("duration_sec").alias("dur"), F.col("forward_packets").alias("spkts"), F.col("reverse_packets").alias("dpkts"),
        F.col("forward_bytes").alias("sbytes"), F.col("reverse_bytes").alias("dbytes"), F.col("bytes_per_sec").alias("rate"),
        F.col("fwd_iat_mean").alias("sinpkt"), F.col("rev_iat_mean").alias("dinpkt"),
        F.when(F.col("protocol") == 6, "TCP").otherwise("udp").alias("proto"),
        F.when(n % 3 == 0, "  ").when(n % 3 == 1, " Backdoor ").otherwise("Analysis").alias("attack_cat"), (n % 2).alias("label"))
    out = D.mapped(rows, D.unsw_features(), F.col("flow_id"), D.canonical_label(D.unsw_raw_label(), S.UNSW_LABELS).alias("label"))
    return rounded(out.select("flow_id", "label", "total_packets", F.round("packets_per_sec", 2).alias("packets_per_sec"),
                              "fwd_rev_byte_ratio", "protocol", "is_udp", "iat_mean"))


@query("dataset_compatibility", B.with_views("""
select availability, features, round(features*100.0/52,6)+0.0 as percent, (select count(*) from features) as rows from (values ('DIRECT',29),('DERIVED',12),('MISSING',11)) t(availability, features)""", "features"))
def dataset_compatibility(spark, sf):
    """What a CIC table can provide, next to the number of rows projected from it."""
    table = D.availability(spark, D.cic_features()).groupBy("availability").agg(F.count("*").alias("features"))
    rows = D.mapped(_as_cic(B.stored_features(spark, sf)), D.cic_features()).agg(F.count("*").alias("rows"))
    from quietwire.operators.clock import with_scalars

    return rounded(with_scalars(table.withColumn("percent", F.col("features") * 100.0 / 52), rows))


@query("label_mapping", """
select case event_type when 'click' then 'ddos' when 'view' then 'benign' when 'purchase' then 'c2' else 'unknown' end as label, count(*) as n from events group by all""")
def label_mapping(spark, sf):
    """Event types through a label table."""
    table = {"click": "ddos", "view": "benign", "purchase": "c2"}
    return B.table(spark, sf, "events").groupBy(D.canonical_label(F.col("event_type"), table).alias("label")).agg(F.count("*").alias("n"))


@query("event_label_fallback", """
select case when event_type='view' then (case when user_id%2=0 then 'Normal' else 'Generic' end) else event_type end as raw_label, count(*) as n from events group by all""")
def event_label_fallback(spark, sf):
    """B14."""
    e = B.table(spark, sf, "events").withColumns({
        "attack_cat": F.when(F.col("event_type") == "view", " Normal ").otherwise(F.col("event_type")), "label": F.col("user_id") % 2})
    return e.groupBy(D.unsw_raw_label().alias("raw_label")).agg(F.count("*").alias("n"))


@query("scenario_rows", B.with_views("select scenario, label, count(*) as n from features group by all", "features"))
def scenario_rows(spark, sf):
    """Rows per scenario and label."""
    return B.stored_features(spark, sf).groupBy("scenario", "label").agg(F.count("*").alias("n"))


B.SQL_VIEWS["feature_split"] = (("features",), """
select f.flow_id, f.src_ip, split from features f join (
 select scenario, case when rn <= t then 'train' when rn <= t + (case when t+v >= n then greatest(0,n-t-1) else v end) then 'validation' else 'test' end as split from (
  select scenario, row_number() over (order by md5(scenario||'#42'), scenario) as rn, count(*) over () as n, greatest(1,floor(count(*) over ()*0.7)) as t, floor(count(*) over ()*0.15) as v
  from (select distinct scenario from features))) using (scenario)""")
_SHARED = """select '{0}' as identity, splits, count(*) as identities from (select {0}, string_agg(distinct split, '+' order by split) as splits, count(distinct split) as c
 from feature_split group by {0}) where c > 1 group by splits"""


@query("leak_free_split", B.with_views(
    "select 'rows' as identity, split as splits, count(*) as identities from feature_split group by split union all " + _SHARED.format("flow_id") + " union all " + _SHARED.format("src_ip"), "feature_split"))
def leak_free_split(spark, sf):
    """C11: whole scenarios per split: no flow is in two splits, sources are."""
    f = B.stored_features(spark, sf)
    rows = L.assign(f, L.scenario_split(f))
    held = rows.groupBy(F.col("split").alias("splits")).agg(F.count("*").alias("identities")).select(F.lit("rows").alias("identity"), "splits", "identities")
    for identity in ("flow_id", "src_ip"):
        held = held.unionByName(L.split_overlap(rows, identity).select(F.lit(identity).alias("identity"), "splits", "identities"))
    return held
