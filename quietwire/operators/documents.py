"""Semi-structured event documents as variants: validation by a table of rules, and allow-listed leaves with bounds.

A document is JSON text. It is parsed once into Spark's variant type; every rule reads a path of it, so no document passes through Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.operators.events import EVENT_ID
from quietwire.session import cut_lineage

OBJECT, LIST, OBJECTS, TEXT, NUMBER, WHOLE = "object", "list", "objects", "text", "number", "whole"

#: What each part of an event document must be if it is there, as (reason, kind, paths).
SHAPES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("observation", OBJECT, ("evidence", "dns_observation", "tls_observation", "quic_observation")),
    ("evidence", OBJECTS, ("behavioral_evidence", "dns_evidence", "tls_evidence", "quic_evidence")),
    ("number", NUMBER, ("classification_score", "anomaly_score", "created_at")),
    ("text", TEXT, ("flow_id", "src_ip", "dst_ip", "capture_interface", "replay_file_identifier")),
    ("model evidence", LIST, ("evidence.items",)),
    ("directions", LIST, ("tls_observation.directions", "quic_observation.directions")),
    ("metadata", OBJECT, ("metadata", "metadata.explanation")),
    ("techniques", LIST, ("metadata.explanation.attack_mappings", "metadata.attack_mappings")),
)
#: Numbers with a greatest value, all from zero.
TOPS = {"src_port": 65535, "dst_port": 65535, "protocol": 255}
SOURCES = ("LIVE", "REPLAY")


def parsed(document: Column) -> Column:
    return F.try_parse_json(document)


def _part(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant")


def _kind(part: Column) -> Column:
    return F.schema_of_variant(part)


def _is(part: Column, kind: str) -> Column:
    """Whether a part is of a kind; missing and null parts are of every kind."""
    found = _kind(part)
    holds = {
        OBJECT: found.startswith("OBJECT"), LIST: found.startswith("ARRAY"), TEXT: found == "STRING", WHOLE: found == "BIGINT",
        OBJECTS: found.startswith("ARRAY<OBJECT") | (found == "ARRAY<VOID>"), NUMBER: found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")}[kind]
    return part.isNull() | (found == "VOID") | holds


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "string")


def _rules(doc: Column) -> Iterable[tuple[str, Column]]:
    """(reason, what must hold), in the order in which reasons are given."""
    name = F.when(_kind(_part(doc, "id")) == "STRING", _text(doc, "id"))
    yield "document", F.coalesce(_kind(doc).startswith("OBJECT"), F.lit(False))
    yield "identity", F.coalesce(name.rlike(EVENT_ID), F.lit(False))
    yield "time", _part(doc, "timestamp").isNotNull() & (_kind(_part(doc, "timestamp")) != "VOID") & _is(_part(doc, "timestamp"), NUMBER)
    yield "source", F.coalesce(_text(doc, "source_mode").isin(*SOURCES), F.lit(True))
    for reason, kind, paths in SHAPES:
        holds = F.lit(True)
        for path in paths:
            holds = holds & _is(_part(doc, path), kind)
        yield reason, holds
    yield "directions", _part(doc, "dns_observation.directions").isNull()
    for family in ("tls", "quic"):
        yield "directions", F.coalesce(F.size(F.try_variant_get(doc, f"$.{family}_observation.directions", "array<variant>")) <= 2, F.lit(True))
    yield "conflicting identity", F.coalesce(_text(doc, "event_id") == _text(doc, "id"), F.lit(True))
    yield "conflicting class", F.coalesce(_text(doc, "threat_type") == _text(doc, "threat_class"), F.lit(True))
    for path, top in TOPS.items():
        value = F.try_variant_get(doc, f"$.{path}", "bigint")
        yield "endpoint", _is(_part(doc, path), WHOLE) & F.coalesce(value.between(0, top), F.lit(True))


def document_validity(events: DataFrame, document: str = "document") -> DataFrame:
    """Adds ``reject_reason``, the first rule that a document breaks (null for a valid one), and ``is_valid``."""
    rows = events.withColumn("_doc", parsed(F.col(document)))
    reason = F.coalesce(*[F.when(~holds, F.lit(name)) for name, holds in _rules(F.col("_doc"))])
    return rows.withColumn("reject_reason", reason).withColumn("is_valid", F.col("reject_reason").isNull()).drop("_doc")


@dataclass(frozen=True)
class Bounds:
    """What a projected document may hold at most."""

    depth: int = 10
    members: int = 256
    items: int = 128
    characters: int = 4096


def projected_leaves(events: DataFrame, key: str, allowed: Iterable[str], bounds: Bounds = Bounds(), document: str = "document") -> DataFrame:
    """The leaves of every document below allow-listed names only: ``key``, ``path``, ``kind``, ``value``; and a row with ``kind`` REFUSED and the
    reason as value for a document beyond the bounds.

    Levels are unfolded one after the other, each stored once; what is not allowed is dropped before it is unfolded.
    """
    names = F.array(*[F.lit(n) for n in allowed])
    level = events.select(F.col(key), F.lit("").alias("path"), parsed(F.col(document)).alias("v"))
    leaves, refused = None, None

    def gathered(all_: DataFrame | None, more: DataFrame) -> DataFrame:
        return more if all_ is None else all_.unionByName(more)

    for depth in range(bounds.depth + 2):
        rows = cut_lineage(level).withColumn("kind", _kind(F.col("v")))
        text = F.col("v").cast("string")
        inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        wide = F.when(F.col("kind").startswith("ARRAY"), F.size(F.try_variant_get("v", "$", "array<variant>")) > bounds.items).when(
            F.col("kind").startswith("OBJECT"), F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))) > bounds.members)
        reason = (F.when(F.lit(depth > bounds.depth), "depth").when(wide, "size").when((F.col("kind") == "STRING") & (F.char_length(text) > bounds.characters), "text"))
        rows = rows.withColumn("reason", reason)
        refused = gathered(refused, rows.filter("reason is not null").select(key, "reason"))
        rows = rows.filter("reason is null")
        leaves = gathered(leaves, rows.filter(~inner).select(key, "path", "kind", text.alias("value")))
        if depth > bounds.depth:
            break
        members = rows.filter(F.col("kind").startswith("OBJECT")).select(key, "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v"))
        members = members.filter(F.array_contains(names, F.col("name"))).select(key, F.concat_ws(".", F.expr("nullif(path, '')"), "name").alias("path"), "v")
        items = rows.filter(F.col("kind").startswith("ARRAY")).select(key, "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("nth", "v"))
        level = members.unionByName(items.select(key, F.concat("path", F.lit("["), "nth", F.lit("]")).alias("path"), "v"))
    bad = refused.groupBy(key).agg(F.min("reason").alias("value"))
    kept = leaves.join(bad.select(key), key, "left_anti")
    return kept.unionByName(bad.select(key, F.lit("").alias("path"), F.lit("REFUSED").alias("kind"), "value"))
