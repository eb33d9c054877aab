"""Ids against the file's library, the plan against naive best fit, and places without gaps or overlaps."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietwire.llm import packing as P
from quietwire.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return P.Encoder(vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t'ast<|endofx>é1_🙂　", max_size=60))
def test_ids_are_the_librarys(encoder, text):
    assert encoder.quick is not None
    for own in (text, text + "<|endoftext|>" + text):
        assert encoder.ids(own).tolist() == encoder.library.encode(own, add_special_tokens=False).ids


def test_ids_of_texts_in_parts(encoder, monkeypatch):
    text = ("Some words, 12 numbers   and\n\n'll marks. " * 60 + "x" * 700 + " " * 90) * 3
    whole = encoder.library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(P, "PART_CHARS", 100)
    assert len(list(encoder._parts(text))) > 20 and encoder.ids(text).tolist() == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200))
def test_plan_is_best_fit(lengths):
    slots, rooms = P.plan(Counter(lengths), 30), []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(30 - length)
    used = {}
    for length, count in Counter(lengths).items():
        own = sorted((s for s in slots if s.length == length), key=lambda s: s.rank)
        for slot, upto in zip(own, [s.rank for s in own[1:]] + [count]):
            for nth in range(upto - slot.rank):
                used.setdefault(slot.sequence + nth // slot.each, []).append((slot.offset + nth % slot.each * length, length))
    assert len(used) == len(rooms)
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 30


def test_plan_size_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 256)
    small, large = (P.plan({i + 1: int(c) * many for i, c in enumerate(counts)}, 256) for many in (1, 10 ** 6))
    assert len(large) < 20 * 256 and len(small) < 20 * 256


def test_packed_documents(spark, docs_frame, encoder):
    texts = ["", None, "word " * 5000, "ab", "ab", "<|endoftext|>"] + [f"text {i} " * (i % 70) for i in range(150)]
    docs = docs_frame(*[(5 if i > 100 else i, t) for i, t in enumerate(texts)], more="length piece _row ids")
    rows = P.packed(docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))), vocabulary_path(), 256).collect()
    by_doc, by_place, lengths = {}, {}, 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, ids.tolist()))
        by_place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths += r.length
    for doc_id, text in [(i, t) for i, t in enumerate(texts) if i < 5 or 5 < i <= 100] + [(None, "ab")]:
        expected = encoder.library.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id])
        assert [p for p, _, _ in pieces] == list(range(-(-len(expected) // 256)))
        assert [i for _, _, ids in pieces for i in ids] == expected and [s for _, s, _ in pieces] == [len(expected) - sum(len(i) for _, _, i in pieces[k:]) for k in range(len(pieces))]
        assert all(len(ids) == 256 for _, _, ids in pieces[1:])
    for held in by_place.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_place) <= -(-lengths // 256) + 2
    whole = {r.sequence_id: r.ids for r in P.sequences(spark.createDataFrame(rows)).collect()}
    assert sum(map(len, whole.values())) == 4 * lengths
    report = P.packing_report(docs.where("doc_id = 2"), vocabulary_path(), 256).collect()
    assert {(r.piece, r.ids_crc32) for r in report} == {(r.piece, zlib.crc32(bytes(r.ids))) for r in rows if r.doc_id == 2}
    assert P.packed(docs.limit(0), vocabulary_path()).collect() == []


def test_tiles_of_one_length_do_not_collide(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5 + 1).cast("long").alias("length"))
    got = P.placed(rows, 16).collect()
    places = {(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}
    assert len(got) == 3000 and len(places) == sum(r.length for r in got) and max(o for _, o in places) < 16
