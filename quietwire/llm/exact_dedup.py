"""Exact duplicates by two passes of Bloom filtering; only possibly repeated rows are shuffled.

A Bloom filter of fixed size marks the cells that at least two rows hash to.
Pass one filters all rows with one hash function, pass two filters what is left
with a second, independent one. Rows that either pass clears are unique and go
straight to the result. The remaining rows are grouped by the digest of their
normalised text, so false positives of the filters cost a little shuffle and
never change the result.

The filters have ``2 ** cell_bits`` cells, stored 64 to a word; only words with a repeated
cell are kept, so the looked-up table has at most ``2 ** (cell_bits - 6)`` rows of two longs whatever
the corpus. Beyond about a billion rows the filters saturate and more rows take the grouped path.

Cases: null text counts as empty; empty texts are equal to one another; rows that tie in length and
doc_id are ordered by text and then by arrival, so one of identical rows stays; a null doc_id orders last;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, written

BLANKS = r"[\x20\x09-\x0D]"
CELL_BITS = 27
SALTS = 64
SEEDS = (11, 29)


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line ends, vertical tabs and form feeds."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _cell(seed: int, cell_bits: int) -> Column:
    """The Bloom cell of ``_digest`` under the hash function ``seed``."""
    return F.xxhash64(F.col("_digest"), F.lit(seed)).bitwiseAND(F.lit((1 << cell_bits) - 1))


def repeated_cells(rows: DataFrame, seed: int, cell_bits: int) -> DataFrame:
    """The filter: (_word, _bits), one bit for each cell that two or more of ``rows`` hit."""
    cell = F.col("_cell")
    hit = rows.select(_cell(seed, cell_bits).alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_n")).where("_n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))
    return hit.groupBy(F.shiftright(cell, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def possibly_repeated(rows: DataFrame, marks: DataFrame, seed: int, cell_bits: int, flag: str) -> DataFrame:
    """``rows`` with ``flag``: the filter holds the row's cell. The filter is broadcast only if the planner finds it small."""
    place = _cell(seed, cell_bits).bitwiseAND(F.lit(63)).cast("int")
    held = F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(F.lit(1)) == 1
    keyed = rows.withColumn("_word", F.shiftright(_cell(seed, cell_bits), 6))
    return keyed.join(marks, "_word", "left").withColumn(flag, F.coalesce(held, F.lit(False))).drop("_word", "_bits")


def _filters(digests: DataFrame, cell_bits: int) -> tuple[DataFrame, DataFrame]:
    """Both filters; the second one sees only rows that the first one could not clear. Both are stored, as they are used twice."""
    first = written(repeated_cells(digests, SEEDS[0], cell_bits), "bloom")
    left = possibly_repeated(digests, first, SEEDS[0], cell_bits, "_once").where("_once")
    return first, written(repeated_cells(left, SEEDS[1], cell_bits), "bloom")


def _twice(rows: DataFrame, filters: tuple[DataFrame, DataFrame], cell_bits: int) -> DataFrame:
    """``rows`` with ``_maybe``: neither filter clears the row."""
    once = possibly_repeated(rows, filters[0], SEEDS[0], cell_bits, "_once")
    both = possibly_repeated(once, filters[1], SEEDS[1], cell_bits, "_again")
    return both.withColumn("_maybe", F.col("_once") & F.col("_again")).drop("_once", "_again")


def exact_groups(docs: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with most code points, then the smallest doc_id, stays.
    """
    narrow = written(documents_of(docs).select(
        F.monotonically_increasing_id().alias("_uid"), "doc_id", F.char_length("text").alias("_chars"),
        F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("_digest")), "digests")
    rows = _twice(narrow, _filters(narrow.select("_digest"), cell_bits), cell_bits)
    maybe = rows.where("_maybe").withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int"))
    order = F.struct((-F.col("_chars")).alias("chars"), F.col("doc_id").isNull().alias("absent"), "doc_id", F.col("_uid").alias("uid"))
    parts = maybe.groupBy("_digest", "_salt").agg(F.count("*").alias("_n"), F.min(order).alias("_best"))
    groups = parts.groupBy("_digest").agg(F.sum("_n").alias("_size"), F.min("_best").alias("_best"), F.collect_list("_salt").alias("_salts"))
    dealt = groups.select("_digest", "_size", "_best", F.explode("_salts").alias("_salt"))
    text_sha = F.lower(F.hex("_digest")).alias("text_sha256")
    grouped = maybe.join(dealt, ["_digest", "_salt"]).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_best.uid") == F.col("_uid")).alias("kept"), text_sha)
    straight = rows.where("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha)
    return straight.unionByName(grouped)


def keep_first(docs: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Unique rows pass without a shuffle. Of possibly repeated ones each task keeps its best row of a text before anything moves.
    """
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("_digest")
    keyed = docs.select(F.struct("*").alias("_row"), digest)  # whatever the columns are called
    rows = _twice(keyed, _filters(written(docs.select(digest), "digests"), cell_bits), cell_bits)
    text, doc_id = F.coalesce(F.col("_row.text"), F.lit("")), F.col("_row.doc_id")
    order = F.struct(F.char_length(text).alias("chars"), doc_id.isNotNull().alias("known"), (-doc_id).alias("id"), text.alias("text"))
    best = rows.where("_maybe").groupBy("_digest").agg(F.max_by("_row", order).alias("_row")).select("_row.*")
    return rows.where("not _maybe").select("_row.*").unionByName(best)
