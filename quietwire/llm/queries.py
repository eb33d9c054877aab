"""One query for each operator of this subpackage, over whole tables with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.llm import (
    chat_format, conversation_repair, decontaminate, exact_dedup, line_dedup, mixing, ngram_join, packing, quality, secret_scan, token_counts, url_filter, whitening)
from quietwire.llm.tables import literal_rows

#: Fixed value: the vocabulary whose counts op5 gives.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark windows, and how many of their words are covered."""
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


#: Target weights of op4 and the pipeline's last stage.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of op4: the language of the documents that ``labels`` covers."""
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")), "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for the target weights."""
    return mixing.mixed(table(spark, sf_dir, "documents"), language_labels(spark, sf_dir), TARGETS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of whole texts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies and the number of links of each document."""
    return ngram_join.near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


#: Fixed value: what both turns of the added conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and from one whose texts are control strings."""
    added = literal_rows(spark, ("conv_id", "turn", "role", "text"), [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)])
    held = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.round_trip_report(held.unionByName(added))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base patterns and random tokens."""
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that repeat, exactly or nearly, what stands first elsewhere."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight leading principal components, scaled to unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations after damage."""
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of at most 1024 tokens."""
    return packing.packing_report(table(spark, sf_dir, "documents"), vocabulary_path())


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_decontaminate": f"""
with items as (select item_id, {_WORDS} as w from benchmark),
spans as (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from items where len(w) > 0),
windows as (select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as k from spans),
lengths as (select distinct n from windows),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
places as (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, lengths where len(w) >= n),
found as (select p.r, p.i, p.n, x.item_id from (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as k from places) p join windows x using (n, k)),
covered as (select r, count(distinct j) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as j from found) group by r),
listed as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join covered using (r) left join listed using (r)""",
    "op3_exact_dedup": r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256)::bigint as group_size,
 row_number() over g = 1 as kept, text_sha256
from n window g as (partition by text_sha256 order by chars desc, doc_id)""",
}
SQL["op7_chat_format"] = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'),
e as (select *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as t,
 length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) as r from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum(t + r + 8 + 1 + 7)::bigint as formatted_chars from e group by conv_id"""

_BLANK = r"[\x20\x09-\x0D]"
#: crc32 of the bytes of ``k``: the table is made by eight halvings of each byte, the rest is a fold.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::bigint)),
 lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"""
SQL["op12_conversation_repair"] = rf"""
with recursive crc_steps as (select b, b::bigint as c, 0 as i from range(256) t(b)
 union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from crc_steps where i < 8),
crc_table as (select b, c from crc_steps where i = 8),
spaced as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
 coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
kinds as (select *, {_CRC} % 20 as kind from spaced, (select list(c order by b) as crcs from crc_table)),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
 case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
 unnest(case when kind = 3 then [0, 1] else [0] end) as time from kinds where kind <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
faults as (select *, not regexp_matches(text, '[^ 	-
]') as blank,
 row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
 not regexp_matches(text, '[.!?]{_BLANK}*$') as open_end,
 lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as two from ordered),
turns as (select conv_id, i, role, text, blank or seen as must_go, case when open_end then 5 else 0 end as extra from faults),
summary as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank)::bigint as blank,
 count(*) filter (seen and not blank)::bigint as duplicate, count(*) filter (open_end and not blank and not seen)::bigint as truncated,
 count(*) filter (two is not null and two not in ('su', 'ua', 'au'))::bigint as illegal, max(i) as last from faults group by conv_id),
-- states: 0 nothing, 1 after s, 2 after u, 3 after a; insertions lead from one to others
inserts(src, dst, n, added) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'),
 (3, 2, 1, chr(10) || 'user:'), (2, 3, 1, chr(10) || 'assistant:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')),
moves(src, dst, r, name) as (values (0, 1, 's', null), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
walk as (select distinct conv_id, 0::bigint as i, dst as state, 5 * n as cost, repeat('I', n) as audit, added as said from conversations, inserts where src = 0
 union all
 select conv_id, i, state, cost, audit, said from (
  select w.conv_id, q.i, x.dst as state, w.cost + e.cost + 5 * x.n as cost, w.audit || e.edit || repeat('I', x.n) as audit, w.said || e.said || x.added as said
  from walk w join turns q on w.conv_id is not distinct from q.conv_id and q.i = w.i + 1,
  lateral (select 'D' as edit, 2 as cost, w.state as state, '' as said
   union all select 'K', q.extra, m.dst, chr(10) || q.role || ':' || q.text from moves m where m.src = w.state and m.r = left(q.role, 1) and not q.must_go
   union all select 'R', 1 + q.extra, m.dst, chr(10) || m.name || ':' || q.text from moves m where m.src = w.state and m.name is not null and not q.must_go) e,
  inserts x where x.src = e.state)
 qualify row_number() over (partition by conv_id, i, state order by cost, audit) = 1),
ended as (select w.* from walk w left join summary s on w.conv_id is not distinct from s.conv_id where w.i = coalesce(s.last, 0) and w.state in (0, 3)
 qualify row_number() over (partition by w.conv_id order by cost, audit) = 1)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
 coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost::bigint as cost, audit, sha256(substr(said, 2)) as repaired_sha256
from ended e left join summary s on e.conv_id is not distinct from s.conv_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}
