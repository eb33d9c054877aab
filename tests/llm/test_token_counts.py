"""Counts against the library that the vocabulary belongs to: whole texts, and every prefix."""

import random

import pytest

from quietwire.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a   b\n\n  c d'll we're '' 're <|endoftext|>x !!<|endoftext|> <|endo", "  \t x  y 12 3.5 ééé 中文字 🙂🙂", "'ve 've'll \n ", "a" * 300 + "-" * 90, "\r\n\r\n x", "a \nb\n c  ",
       " x  y\x1c z"]
PARTS = ["a", "'", "re", " ", "  ", "\n", "é", "!", "ll", "12", "<|endoftext|>", "Z", "\t", "日", "the", ",", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(PATH)
    return lambda text: len(loaded.encode(text, add_special_tokens=False).ids)


def _texts(n, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_every_prefix(library):
    count = T.counter(PATH)
    for text in _texts(150):
        assert count.at_every_prefix(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)], text


def test_totals(library, monkeypatch):
    texts = _texts(400, 2)
    assert T.counter(PATH).totals(texts) == [library(t) for t in texts]
    monkeypatch.setattr(T, "CACHED_PIECES", 20)
    small = T.PrefixCounts(T.Vocabulary(PATH))
    assert [n for i in range(0, len(texts), 7) for n in small.totals(texts[i:i + 7])] == [library(t) for t in texts]


def test_query_columns_and_budgets(docs_frame, library):
    texts = [None, "", "word " * 3000, "plain text", "plain text"]
    docs = docs_frame(*enumerate(texts), (None, "x"), more="n_tokens counts")
    rows = {r.doc_id: r for r in T.token_counts(docs, PATH).collect()}
    assert [(rows[i].n_bytes, rows[i].n_tokens) for i in range(5)] == [(len((t or "").encode()), library(t or "")) for t in texts]
    assert rows[2].over_limit and not rows[3].over_limit and len(rows) == 6
    tables = T.prefix_tables(docs.where("doc_id in (1, 2, 3)"), PATH).select("doc_id", T.tokens_at("counts", 7).alias("seven"), T.chars_within("counts", 2).alias("two"))
    cut = {r.doc_id: (r.seven, r.two) for r in tables.collect()}
    assert cut == {i: (library(texts[i][:7]), T.counter(PATH).longest_prefix(texts[i], 2)) for i in (1, 2, 3)}
    assert T.token_counts(docs.limit(0), PATH).count() == 0
