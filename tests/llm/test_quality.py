"""Held-out accuracy on the sample, hashing of words, and the edge cases."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quietwire.llm import quality as Q
from quietwire.llm import word_hashes as W

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("piece", [64, 1 << 22])
def test_words_are_those_of_each_text(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE_BYTES", piece)
    texts = ["Ab cd", "", "cd", "éa-cd x", "   ", "AB", "lang " * 200]
    raw, bounds = W.buffers(pa.array(texts))
    hashes, owner = W.words(raw, bounds)
    assert owner.tolist() == [0, 0, 2, 3, 3, 3, 5] + [6] * 200
    names = {}
    for h, word in zip(hashes.tolist(), ["ab", "cd", "cd", "éa", "cd", "x", "ab"] + ["lang"] * 200):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    marked, _ = W.words(raw, bounds, lower=False, marks=True)
    assert len(marked) == 208


def test_pooling_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, bucket = rng.normal(size=(50, 4)).astype(np.float32), rng.integers(0, 50, 200)
    owner = np.sort(rng.integers(0, 7, 200))
    whole = Q.pooled(bucket, owner, 8, vectors)
    monkeypatch.setattr(Q, "PIECE_WORDS", 11)
    assert np.allclose(whole, Q.pooled(bucket, owner, 8, vectors), atol=1e-4)
    assert not whole[7].any()
    held = vectors[bucket[owner == 2]]
    assert np.allclose(whole[2, :4], held.mean(axis=0), atol=1e-5)
    assert np.isclose(whole[2, 8], (held[1:] * held[:-1]).sum() / (len(held) - 1), atol=1e-5)


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.quality_scores(docs, labels)
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"])
    assert (rows["predicted"] == rows["quality"]).mean() > 0.93
    # labels of held-out rows are not read
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.quality_scores(docs, turned)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, again.collect()))


def test_edge_cases(docs_frame, spark):
    docs = docs_frame((1, None), (2, ""), (3, "?!"), (4, "good words here"), (4, "good words here"), (None, "x"), more="score features predicted")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (9, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert Q.accepted(docs, labels).columns == docs.columns


def test_vectors_and_scores_against_plain_loops(spark, docs_frame):
    """Word vectors, pooled features and scores of a tiny corpus, word by word."""
    import re

    rng = np.random.default_rng(11)
    vocabulary = ["alpha", "beta", "Gamma", "déjà", "12", "!!", "omega", "x"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 30))) for _ in range(60)] + ["", None, "alpha", "!!?beta  12"]
    docs = docs_frame(*enumerate(texts)).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")

    def bucket(word):
        raw, bounds = W.buffers(pa.array([word]))
        found, _ = Q.bucketed(raw, bounds)
        assert len(found) == 1
        return int(found[0])

    split = [[bucket(w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", t or "")] for t in texts]
    places, signs = Q.index_vectors()
    table = np.zeros((Q.BUCKETS, Q.DIMENSIONS))
    for words in split:
        for one, other in [*zip(words, words[1:]), *zip(words[1:], words)]:
            for place, sign in zip(places[other], signs[other]):
                table[one, place] += sign
    used = np.abs(table).sum(axis=1) > 0
    table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True)
    table[used] -= table[used].mean(axis=0)
    table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True)
    assert np.allclose(Q.word_vectors(docs), table, atol=1e-5)
    features = np.zeros((len(texts), 2 * Q.DIMENSIONS + 2))
    for row, words in zip(features, split):
        if words:
            own = table[words]
            beside = [a @ b for a, b in zip(own, own[1:])]
            row[:] = [*own.mean(axis=0), *own.std(axis=0), sum(beside) / max(len(beside), 1), np.log1p(len(words))]
    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    network = Q.fit(features[known].astype(np.float32).astype(np.float64), np.array([float(i % 2) for i in known]))
    expected = network.probability(features)
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert max(abs(got[i].score - expected[i]) for i in range(len(texts))) < 0.02
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5) for i in got)
