"""Queries over DNS messages and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.functions import lexical as X
from quietwire.functions.lexical import long_text_entropy
from quietwire.operators import dns as N
from quietwire.operators.clock import tick
from quietwire.operators.flows import flows
from quietwire.operators.windows import closing_ticks
from quietwire.plans import bindings as B
from quietwire.plans import message_queries  # noqa: F401  (its views)
from quietwire.plans.registry import query, rounded
from quietwire.schema import DnsParams, FlowParams, WindowParams

P = DnsParams(window_sec=600, bucket_sec=10, long_query=60, min_queries=4, unique_domains=4, unique_subdomains=3,
              query_rate=0.005, high_entropy_ratio=0.3, long_label_ratio=0.3, nxdomain_ratio=0.3, min_responses=3, txt_ratio=0.25)
FLOWS = FlowParams(idle_sec=20.0)
CLOSING = WindowParams(window_sec=600, bucket_sec=10)
_PK = "client, server, client_port, transaction_id, qname, qtype"

V = B.SQL_VIEWS
V["dpair"] = (("dns",), f"""
select *, case when pos%2=0 then 'PAIRED' when qr then 'RESPONSE_ONLY' else 'QUERY_ONLY' end as visibility,
 pos%2=0 and (case when qr then rcode=3 else prc=3 end) as paired_nx from (
 select *, row_number() over (partition by {_PK}, run order by pkt_seq) as pos from (
  select *, sum(case when pqr is null or pqr=qr or abs(ts-pts)>10 then 1 else 0 end) over (partition by {_PK} order by pkt_seq) as run from (
   select *, lag(qr) over w as pqr, lag(ts) over w as pts, lag(rcode) over w as prc from dns window w as (partition by {_PK} order by pkt_seq))))""")
V["names"] = (("dns",), "select distinct qname as name from dns")
V["chars"] = (("names",), "select name, lab, li, c from (select name, lab, li, unnest(string_split(lab,'')) as c from (select name, unnest(string_split(name,'.')) as lab, unnest(range(len(string_split(name,'.')))) as li from names))")
V["labent"] = (("chars",), "select name, li, sum(n)::bigint as len, -sum(n/tot*log2(n/tot)) as ent from (select name, li, n, sum(n) over (partition by name, li) as tot from (select name, li, c, count(*) as n from chars group by all)) group by name, li")
V["nstat"] = (("labent", "chars"), """
select n.name, length(n.name) as qname_length, max(li)+1 as label_count, max(len) as longest_label, max(ent) as max_label_entropy,
 max(ent) filter (len>=20) as strong, coalesce(bool_or(len>=20 and ent>=3.5),false) as high, array_to_string(string_split(n.name,'.')[-2:],'.') as parent from labent n group by n.name""")
V["dmsg"] = (("dpair", "nstat"), "select d.*, s.qname_length, s.longest_label, s.high, s.parent, s.strong, floor(ts/10)::bigint as tick from dpair d join nstat s on s.name=d.qname")
V["dk"] = (("dns",), "select *, case when src_ip < dst_ip then src_ip||':'||src_port||'-'||dst_ip||':'||dst_port else dst_ip||':'||dst_port||'-'||src_ip||':'||src_port end||'-17' as direction_key from dns")
V["dflow"] = (("dk",), """
select direction_key, seg, sha256(direction_key||'#'||min(pkt_seq)) as flow_id, min(ts) as start_time, max(ts) as end_time from (
 select *, sum(case when l is null or ts-l >= 20 then 1 else 0 end) over (partition by direction_key order by pkt_seq) as seg from (
  select *, lag(ts) over (partition by direction_key order by pkt_seq) as l from dk)) group by direction_key, seg""")
V["dclose"] = (("dflow", "dns"), "select *, coalesce((select min(floor(ts/10)) from dns where ts >= end_time+20), (select max(floor(ts/10)) from dns))::bigint as eval_tick from dflow")
V["dobs"] = (("dclose", "dk", "dmsg"), """
select f.flow_id, f.eval_tick, f.end_time, m.client, m.parent, m.qname, m.longest_label, m.qname_length, m.strong, m.visibility from dclose f left join (
 select f.flow_id, arg_max(d.pkt_seq, d.ts*1e6+d.pkt_seq/1e6) as pkt_seq from dclose f join dk d on d.direction_key=f.direction_key and d.ts between f.start_time and f.end_time group by all) l using (flow_id)
left join dmsg m on m.pkt_seq=l.pkt_seq""")


def _win(scope, pts):
    on = " and ".join(f"m.{c}=p.{c}" for c in scope)
    cols = ", ".join(f"p.{c}" for c in scope)
    return f"""
select {cols}, p.t, count(*) filter (not qr) as query_messages, count(*) filter (qr) as response_messages, count(*) filter (qr and rcode=3) as nxdomain,
 count(*) filter (visibility='PAIRED') as paired, count(*) filter (paired_nx) as paired_nxdomain, count(*) filter (not qr) as questions,
 count(distinct qname) filter (not qr) as unique_domains, count(distinct m.parent) filter (not qr) as unique_parents,
 count(*) filter (not qr and high)/greatest(count(*) filter (not qr),1) as high_entropy_ratio, count(*) filter (not qr and longest_label>=40)/greatest(count(*) filter (not qr),1) as long_label_ratio,
 count(*) filter (not qr and qname_length>=60)/greatest(count(*) filter (not qr),1) as long_query_ratio, count(*) filter (not qr and qtype=16)/greatest(count(*) filter (not qr),1) as txt_ratio,
 sum(qname_length) filter (not qr)/nullif(count(*) filter (not qr),0) as mean_query_length, count(*) filter (qr and rcode=3)/nullif(count(*) filter (qr),0) as nxdomain_ratio,
 count(*) filter (paired_nx)/nullif(count(*) filter (visibility='PAIRED'),0) as paired_nxdomain_ratio
from {pts} p join dmsg m on {on} and m.tick between p.t-59 and p.t group by all"""


V["cpts"] = (("dmsg",), "select distinct client, tick as t from dmsg")
V["cwin"] = (("cpts", "dmsg"), _win(["client"], "cpts"))
V["spts"] = (("dmsg",), "select distinct server, tick as t from dmsg")
V["swin"] = (("spts", "dmsg"), _win(["server"], "spts"))
V["ppts"] = (("dmsg",), "select distinct client, parent, tick as t from dmsg")
V["pwin"] = (("ppts", "dmsg"), _win(["client", "parent"], "ppts"))
V["ecp"] = (("dobs",), "select distinct client, eval_tick as t from dobs where client is not null")
V["ecw"] = (("ecp", "dmsg"), _win(["client"], "ecp"))
V["epp"] = (("dobs",), "select distinct client, parent, eval_tick as t from dobs where client is not null")
V["epw"] = (("epp", "dmsg"), _win(["client", "parent"], "epp"))
V["dsig"] = (("dobs", "ecw", "epw"), """
select flow_id, 'DNS_LEXICAL_ANOMALY' as signal_type, longest_label::double as observed_value from dobs where longest_label>=40
union all select flow_id, 'DNS_LEXICAL_ANOMALY', qname_length from dobs where longest_label<40 and qname_length>=60
union all select flow_id, 'DNS_HIGH_ENTROPY_LABEL', strong from dobs where strong>=3.5
union all select flow_id, 'DNS_UNIQUE_DOMAIN_RATE', unique_domains/600 from dobs o join ecw w on w.client=o.client and w.t=o.eval_tick where unique_domains>=4
union all select flow_id, 'DNS_NXDOMAIN_PATTERN', nxdomain_ratio from dobs o join ecw w on w.client=o.client and w.t=o.eval_tick where response_messages>=3 and nxdomain_ratio>=0.3
union all select flow_id, 'DNS_QTYPE_PATTERN', txt_ratio from dobs o join ecw w on w.client=o.client and w.t=o.eval_tick where questions>=4 and txt_ratio>=0.25
union all select flow_id, 'DGA_LIKE_BEHAVIOR', high_entropy_ratio from dobs o join ecw w on w.client=o.client and w.t=o.eval_tick where questions>=4 and unique_parents>=4
 and high_entropy_ratio>=0.3 and (coalesce(paired>=3 and paired_nxdomain_ratio>=0.3,false) or long_label_ratio>=0.3)
union all select flow_id, 'DNS_TUNNELLING_LIKE_BEHAVIOR', unique_domains from dobs o join epw w on w.client=o.client and w.parent=o.parent and w.t=o.eval_tick
 where questions>=4 and unique_domains>=3 and high_entropy_ratio>=0.3 and long_label_ratio>=0.3 and questions/600>=0.005""")


def paired(spark, sf):
    return B.stored(spark, sf, "dns", lambda: N.paired_messages(B.dns(spark, sf), P.pair_ttl_sec))


def observed(spark, sf):
    def build():
        p = B.dns(spark, sf).select("pkt_seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                                    F.lit(100).alias("ip_total_length"), F.lit(60).alias("payload_size"),
                                    F.lit(None).cast("int").alias("tcp_flags"))
        closed = closing_ticks(flows(p, FLOWS, in_order=False), p, FLOWS, CLOSING)
        return N.latest_in_flow(closed, paired(spark, sf))

    return B.stored(spark, sf, "dns_flows", build)


def dns_signals(spark, sf):
    o = observed(spark, sf)
    return N.question_signals(o, P).unionByName(N.window_signals(o, paired(spark, sf), P))


@query("dns_pairing", B.with_views("select pkt_seq, client, transaction_id, qr, visibility, paired_nx from dpair", "dpair"))
def dns_pairing(spark, sf):
    """C6, B26."""
    return N.paired_messages(B.dns(spark, sf), P.pair_ttl_sec).select("pkt_seq", "client", "transaction_id", "qr", "visibility", "paired_nx")


@query("dns_name_statistics", B.with_views("""
select s.name, qname_length, label_count, longest_label, round(max_label_entropy,6)+0.0 as max_label_entropy, parent,
 round(len(list_filter(string_split(replace(s.name,'.',''),''), lambda c: c >= '0' and c <= '9'))/length(replace(s.name,'.','')),6)+0.0 as digit_ratio,
 len(list_distinct(string_split(replace(s.name,'.',''),''))) as unique_characters, greatest(0,label_count-2) as subdomain_depth_proxy from nstat s""", "nstat"))
def dns_name_statistics(spark, sf):
    """B20, B21, B22."""
    names = B.dns(spark, sf).select(F.col("qname").alias("name")).distinct().withColumn("s", X.name_statistics(F.col("name")))
    return rounded(names.select(
        "name", "s.qname_length", "s.label_count", "s.longest_label", "s.max_label_entropy", X.parent_name(F.col("name")).alias("parent"),
        "s.digit_ratio", "s.unique_characters", "s.subdomain_depth_proxy"))


@query("dns_type_counts", B.with_views("""
select client, qtype, case qtype when 1 then 'A' when 16 then 'TXT' end as qtype_name, count(*) as n from dns where not qr group by all""", "dns"))
def dns_type_counts(spark, sf):
    """B23, D20."""
    return N.type_counts(N.oriented(B.dns(spark, sf)), ["client"])


@query("dns_status_counts", B.with_views("""
select case when hidden then 'ENCRYPTED_OR_UNAVAILABLE' when cut then 'TRUNCATED' else 'PARSED' end as status, count(*) as messages
from (select *, unnest(case when framed and not hidden and pid % 9 = 0 then [1, 2] else [1] end) as time from dns_wire) group by all""", "dns_wire"))
def dns_status_counts(spark, sf):
    """What became of the messages that were written as bytes."""
    from quietwire.plans.message_queries import dns_packets
    from quietwire.sources.messages import dns_messages

    return N.status_counts(dns_messages(dns_packets(spark, sf)))


_W = ("query_messages", "response_messages", "nxdomain", "paired", "paired_nxdomain", "questions", "unique_domains")
_R = ("high_entropy_ratio", "long_label_ratio", "long_query_ratio", "txt_ratio", "mean_query_length", "nxdomain_ratio", "paired_nxdomain_ratio")
_SEL = ", ".join(_W) + ", " + ", ".join(f"round({c},6)+0.0 as {c}" for c in _R)


def _scope(spark, sf, scope):
    m = paired(spark, sf)
    points = m if "parent" not in scope else N.question_rows(m, P)
    points = points.withColumn("tick", tick(F.col("ts"), P.bucket_sec))
    return rounded(N.scope_windows(m, points, scope, P).select(*scope, "tick", *_W, *_R))


@query("dns_client_windows", B.with_views(f"select client, t as tick, {_SEL} from cwin", "cwin"))
def dns_client_windows(spark, sf):
    """D20 per client."""
    return _scope(spark, sf, ["client"])


@query("dns_server_windows", B.with_views(f"select server, t as tick, {_SEL} from swin", "swin"))
def dns_server_windows(spark, sf):
    """D20 per server, which answers every client: the hottest key there is."""
    return _scope(spark, sf, ["server"])


@query("dns_parent_windows", B.with_views(f"select client, parent, t as tick, {_SEL} from pwin", "pwin"))
def dns_parent_windows(spark, sf):
    """D20 per client and parent name."""
    return _scope(spark, sf, ["client", "parent"])


@query("dns_flow_observation", B.with_views("select flow_id, qname, visibility, case when qname is null then 'unavailable_or_not_observed' else 'PARSED' end as dns_status from dobs", "dobs"))
def dns_flow_observation(spark, sf):
    """C8, E9, B46."""
    return observed(spark, sf).select("flow_id", "m.qname", "m.visibility", "dns_status")


@query("dns_signals", B.with_views("select flow_id, signal_type, round(observed_value,6)+0.0 as observed_value from dsig", "dsig"))
def dns_signal_rows(spark, sf):
    """I13-I19."""
    return rounded(dns_signals(spark, sf).select("flow_id", "signal_type", "observed_value"))


@query("dns_techniques", B.with_views("select distinct flow_id, 'T1071.004' as technique_id, 'possible' as qualification from dsig where signal_type='DNS_TUNNELLING_LIKE_BEHAVIOR'", "dsig"))
def dns_techniques(spark, sf):
    """I20."""
    return N.technique_context(dns_signals(spark, sf)).select("flow_id", "technique_id", "qualification")


@query("document_entropy", """
select doc_id, round(-sum(n/tot*log2(n/tot)),5)+0.0 as entropy from (select doc_id, n, sum(n) over (partition by doc_id) as tot from (
 select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(text,'')) as c from documents) group by all)) group by doc_id""")
def document_entropy(spark, sf):
    """B20 for long texts: characters are counted inside the row, nothing is shuffled."""
    d = B.table(spark, sf, "documents").filter("text <> ''")
    return rounded(d.select("doc_id", long_text_entropy(F.col("text")).alias("entropy")), 5)
