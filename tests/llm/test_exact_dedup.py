"""Exact dedup against a plain grouping, with ties, repeated rows, nulls and filters that saturate."""

import hashlib
import re

from quietwire.llm import exact_dedup as X

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\v\f\r"), (7, "x y"), (8, "xy"), (9, "a b "), (9, "a b "),
        (None, "a b  "), (10, "unique"), (11, "ab ")]


def wanted(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(key, []).append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for at, (i, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        out.append((i, best[4], len(groups[key]), best[3] == at, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_groups_are_those_of_a_plain_grouping(docs_frame):
    docs = docs_frame(*ROWS, more="kept word bits _maybe").coalesce(1)
    assert got(X.exact_groups(docs)) == wanted(ROWS)


def test_saturated_filters_change_nothing(docs_frame):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    assert got(X.exact_groups(docs_frame(*rows).coalesce(1), cell_bits=6)) == wanted(rows)


def test_filters_clear_most_unique_rows(docs_frame):
    docs = docs_frame(*[(i, f"text {i}") for i in range(300)], (1000, "text 7"))
    from pyspark.sql import functions as F

    keyed = docs.select(F.unhex(F.sha2(X.normalised(F.col("text")).cast("binary"), 256)).alias("_digest"))
    flagged = X._twice(keyed, X._filters(keyed, 20), 20)
    assert 2 <= flagged.where("_maybe").count() <= 4


def test_keep_first_keeps_whole_rows(docs_frame):
    docs = docs_frame(*ROWS, more="digest _row _digest _maybe _bits")
    kept = X.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [
        (None, "a b  "), (6, " \t\n\v\f\r"), (7, "x y"), (8, "xy"), (10, "unique"), (11, "ab ")]))


def test_hot_group_and_empty_table(docs_frame, spark):
    rows = [(i, "same " * 3) for i in range(500)] + [(1000 + i, f"other {i}") for i in range(100)]
    out = X.exact_groups(docs_frame(*rows)).collect()
    assert {(r.keep_id, r.group_size) for r in out if r.doc_id < 500} == {(0, 500)} and sum(r.kept for r in out) == 101
    assert X.exact_groups(docs_frame(*rows).limit(0)).count() == 0 and X.keep_first(docs_frame(*rows).limit(0)).count() == 0
