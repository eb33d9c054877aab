"""Chat formatting of typed content parts into one marked, reversible text per conversation, with placeholders, attachments and a loss mask.

A turn's content is an array of parts (type, text, ref, tokens). A visitor walks them in order: text parts are escaped and joined, image, audio and
document parts become numbered placeholders, whose references and expanded token counts are recorded. A turn is written as ``<|turn|>role``,
a line end, the content and ``<|end|>``.

Inside roles and texts ``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;`` and ``&#91;`` (and a line end in a role as ``&#10;``), so that neither the
template's marks nor control strings of other templates can occur in the output, and reading back restores every text. Placeholders contain ``<|`` and are
told from text by that.

The loss mask is a list of spans (code points of the output, end exclusive) that cover the content of the assistant's turns. Positions come from a running sum
over the rows of a conversation in the same shuffle that gathers it. One formatted conversation is one row, as the output asks for; conversations are not joined or compared.

Cases: null text is empty, a null role is an empty role, a null conv_id is a conversation of its own; turns of equal number are ordered by role, then text; null turns come first;
parts of unknown type keep their type as a placeholder; missing token counts are taken from ``EXPANDED``; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
TURN, END = "<|turn|>", "<|end|>"
#: Tokens that a part of a type takes if the part does not say so.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
TRAINED_ROLE = "assistant"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """The content of a plain text turn: one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visited(parts: Column, first: Column) -> tuple[Column, Column]:
    """(content, attachments) of a turn: what the visitor writes for each part in order, and a record for each part that is not text.

    ``first`` is the number of attachments in the turns before.
    """
    size = F.coalesce(F.size(parts), F.lit(0))
    number = lambda i: first + F.size(F.filter(F.slice(parts, 1, i + 1), lambda p: ~_is_text(p)))
    write = lambda p, i: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), escaped(p["type"]), F.lit(":"), number(i).cast("string"), F.lit("|>")))
    content = F.when(size == 0, F.lit("")).otherwise(F.array_join(F.transform(parts, write), ""))
    usual = F.create_map(*[F.lit(x) for pair in EXPANDED.items() for x in pair])
    record = lambda p, i: F.struct(
        _is_text(p).alias("plain"), number(i).cast("long").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"], usual[p["type"]].cast("long"), F.lit(1).cast("long")).alias("tokens"))
    listed = F.transform(F.filter(F.transform(parts, record), lambda r: ~r["plain"]), lambda r: F.struct(r["number"], r["type"], r["ref"], r["tokens"]))
    return content, F.coalesce(listed, F.array().cast("array<struct<number:bigint,type:string,ref:string,tokens:bigint>>"))


def formatted(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans), attachments, attachment_tokens; ``turns`` has conv_id, turn, role and ``parts``."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts"))
    order = ["turn", "role", F.to_json("parts")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    others = F.coalesce(F.size(F.filter("parts", lambda p: ~_is_text(p))), F.lit(0)).cast("long")
    rows = rows.withColumn("first", F.coalesce(F.sum(others).over(before), F.lit(0)))
    content, attached = visited(F.col("parts"), F.col("first"))
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("content", content).withColumn("attached", attached)
    length = (F.char_length("head") + F.char_length("content") + len(END)).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0))).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    start = F.col("at") + F.char_length("head")
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(start.alias("start"), (start + F.char_length("content")).alias("end")))
    piece = F.struct("place", F.concat("head", "content", F.lit(END)).alias("piece"), span.alias("span"), "attached")
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("held"))
    return held.select(
        "conv_id", F.array_join(F.transform("held", lambda h: h["piece"]), "").alias("formatted"),
        F.filter(F.transform("held", lambda h: h["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("held", lambda h: h["attached"])).alias("attachments")).withColumn(
        "attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted_text: Column) -> Column:
    """The (role, text) turns of a formatted conversation; placeholders stay in the text as they are."""
    pieces = F.slice(F.split(formatted_text, r"<\|turn\|>", -1), 2, 1 << 30)
    role = lambda p: unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n")))
    body = lambda p: unescaped(p.substr(F.char_length(F.substring_index(p, "\n", 1)) + 2,
                                        F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 1 - len(END)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))


def read_loss(formatted_text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(formatted_text.substr(
        (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def round_trip_report(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations (conv_id, turn, role, text)."""
    made = formatted(conversations.select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts")))
    read = made.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learnt", read_loss(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
