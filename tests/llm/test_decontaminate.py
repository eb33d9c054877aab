"""The automaton against a comparison of every window with every position."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quietwire.llm import decontaminate as D

VOCABULARY = ["a", "b", "c", "É", "日本", "x1"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=40), st.lists(st.lists(st.sampled_from(VOCABULARY), max_size=9), max_size=4), st.integers(1, 5))
def test_scanner_equals_brute_force(words, items, size):
    text = " ".join(words)
    table = [(i, "-".join(w)) for i, w in enumerate(items)]
    scanner = D.Scanner(table, size)
    ranges, found = scanner.hits(D.words_of(text))
    n_words, n_hit, ids = D.brute_force(text, table, size)
    assert (len(D.words_of(text)), sum(b - a for a, b in ranges), sorted(found)) == (n_words, n_hit, ids)


def _case(docs_frame, spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "délta", "Ünd", "x9"])
    items = [(1, " ".join(word() for _ in range(20))), (2, "short one"), (3, None), (4, "... !"), (None, "no id here"), (2, "Short, ONE!"), (10, " ".join(word() for _ in range(13)))]
    texts = [items[0][1], "x " + items[0][1].upper() + " y", "a short  one b", "no ID\there", None, "", "?!", items[6][1].replace(" ", "_"), " ".join(word() for _ in range(3000)),
             "filler " * 300 + "short one", items[0][1][:-8]]
    return docs_frame(*enumerate(texts), (0, items[0][1]), more="n_words item_ids spans"), texts + [items[0][1]], items, spark.createDataFrame(items, "item_id long, text string")


def test_report_equals_brute_force(docs_frame, spark):
    docs, texts, items, benchmark = _case(docs_frame, spark)
    for limit in (D.ITEM_BYTES, 60):  # one automaton, and several slices
        found = D.scan(D.documents_of(docs.coalesce(1)), benchmark, item_bytes=limit).collect()
        for row, text in zip(found, texts):
            assert (row.n_words, row.n_hit, list(row.item_ids)) == D.brute_force(text, items)
            low = (text or "").translate(D._LOWER)
            assert sum(len(D.WORD.findall(low[s.start:s.end])) for s in row.spans) == row.n_hit
    report = {(r.doc_id, r.contaminated, r.n_items, r.items_sha256) for r in D.contamination_report(docs, benchmark).collect()}
    assert (0, True, 1, D.digest([1])) in report and (9, False, 1, D.digest([2])) in report and (3, True, 0, D.digest([])) in report


def test_clean_documents_keep_their_columns(docs_frame, spark):
    docs, texts, items, benchmark = _case(docs_frame, spark)
    docs = docs.withColumn("a.b", docs["doc_id"])
    kept = D.clean_documents(docs, benchmark)
    counts = [D.brute_force(t, items)[:2] for t in texts]
    clean = {i for i, (n, hit) in enumerate(counts[:-1]) if not (hit and 20 * hit >= n)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean and {4, 5, 6, 8, 9} <= clean and 0 not in clean


def test_empty_tables(docs_frame, spark):
    docs, texts, _, benchmark = _case(docs_frame, spark)
    assert D.contamination_report(docs.limit(0), benchmark).count() == 0
    rows = D.contamination_report(docs, benchmark.limit(0)).collect()
    assert len(rows) == len(texts) and not any(r.contaminated or r.n_hit for r in rows)
