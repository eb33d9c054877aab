"""Exact byte-pair token counts at every prefix of a text, by dynamic programming over tokens.

A byte-pair encoding is valid exactly if each token encodes to itself and each two neighbours, joined and encoded, come out as those two.
So the encoding of a prefix ends in the one token that fits behind the encoding of what stands before it. The table of last tokens
gives the token count at every prefix in one walk over the bytes, and no prefix is encoded again: truncation ("how many characters
fit in a budget") and counts at any cut are look-ups.

The text is first cut into pieces by the vocabulary's pattern; equal pieces share one table in a bounded cache of each worker. Where
a cut changes the pieces themselves (inside white space, a contraction or a special token) the counts are those of the text cut there.

Cases: null text counts as empty (0 bytes, 0 tokens); special strings inside texts are one token each, as is the library's default;
repeated documents are counted one by one; an empty table gives an empty result; other columns are not looked at. Very long pieces take time
in proportion to their length times the longest token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of

LIMIT = 1024
#: Fixed value: the published pre-tokenisation pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank before white space or at the end may stand inside or at the end of a run of white space.
_RUN = re.compile(r" (?:\s|$)")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Marks that the pattern always cuts off the letters before them.
_ENDS = (",", ".", ";", ":", "!", "?")
CACHED_PIECES = 700_000
GROUP_BYTES = 4 << 20
CACHED_PAIRS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for themselves, others for 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks, tokens and special strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        letters = _byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in saved["added_tokens"] if t["special"]]
        self.tokens = {to_bytes(t) for t in saved["model"]["vocab"] if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in saved["model"]["merges"])
        self.ranks = {(to_bytes(a), to_bytes(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.tokens))

    def encoded(self, raw: bytes) -> tuple[bytes, ...]:
        """The merges applied by rank, leftmost first (used for single tokens and pairs of tokens only)."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        none = len(self.ranks)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)


class PrefixCounts:
    """Token counts at all prefixes of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, int] = {}
        self._chunks: dict[str, int] = {}  # by what follows a blank

    def _learn(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether a token may stand behind another one (or, behind nothing, stands for itself)."""
        if len(self._fits) >= CACHED_PAIRS:
            self._fits.clear()
        fits = self._fits[pair] = self.vocabulary.encoded(pair[0] + pair[1]) == (pair if pair[0] else pair[1:])
        return fits

    def _walk(self, raw: bytes, last: list[bytes], counts: list[int]) -> None:
        """Continues the tables ``last`` (last token) and ``counts`` of a prefix of ``raw`` to its end."""
        tokens, longest, fits = self.vocabulary.tokens, self.vocabulary.longest, self._fits
        for end in range(len(last), len(raw) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = raw[start:end]
                if token in tokens:
                    pair = (last[start], token)
                    fit = fits.get(pair)
                    if fit or fit is None and self._learn(pair):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break

    def of_piece(self, raw: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one piece."""
        last, counts = [b""], [0]
        self._walk(raw, last, counts)
        return counts

    def of_pieces(self, pieces: set[str]) -> dict[str, int]:
        """Totals of several pieces; in sorted order each goes on from the prefix it shares with the one before."""
        totals, before, last, counts = {}, b"", [b""], [0]
        for piece in sorted(pieces):
            raw = piece.encode()
            same = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                same += 1
            del last[same + 1:], counts[same + 1:]
            self._walk(raw, last, counts)
            totals[piece] = counts[-1]
            before = raw
        return totals

    def total(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.specials is None or not any(s in text for s in self.vocabulary.special):
            return sum(self.of_piece(p.encode())[-1] for p in self.pattern.findall(text))
        found = len(self.specials.findall(text))
        return found + sum(self.total(part) for part in self.specials.split(text))

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of many texts. Texts are cut at blanks and each different chunk is counted once.

        A cut before a blank keeps the pieces, except where the blank stands inside or at the end of a run of white space; such
        texts, and those with special strings, are cut by the pattern alone.
        """
        odd = [bool(_RUN.search(t)) or any(s in t for s in self.vocabulary.special) for t in texts]
        cut = [self._cut(t) if o else t.split(" ") for t, o in zip(texts, odd)]
        heads = {c[0] for c, o in zip(cut, odd) if not o}
        chunks = set().union(*(c[1:] for c, o in zip(cut, odd) if not o))
        pieces = set().union(*(c for c, o in zip(cut, odd) if o))
        unknown = {c: [" " + c] if c.isalpha() else [" " + c[:-1], c[-1]] if c[-1:] in _ENDS and c[:-1].isalpha() else self.pattern.findall(" " + c)
                   for c in chunks.difference(self._chunks)}
        first = {c: self.pattern.findall(c) for c in heads}
        pieces = pieces.union(*unknown.values(), *first.values())
        if len(self._pieces) + len(pieces) > CACHED_PIECES:  # keep what is in use
            self._pieces = {p: self._pieces[p] for p in pieces & self._pieces.keys()}
        self._pieces |= self.of_pieces(pieces - self._pieces.keys())
        if len(self._chunks) + len(unknown) > CACHED_PIECES:
            self._chunks = {c: self._chunks[c] for c in chunks & self._chunks.keys()}
        piece, chunk = self._pieces.__getitem__, self._chunks
        chunk |= {c: piece(found[0]) if len(found) == 1 else sum(map(piece, found)) for c, found in unknown.items()}
        return [sum(map(piece, c)) + self._marks(t) if o else sum(map(piece, first[c[0]])) + sum(map(chunk.__getitem__, c[1:]))
                for t, c, o in zip(texts, cut, odd)]

    def _marks(self, text: str) -> int:
        return len(self.specials.findall(text)) if self.specials else 0

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text between its special strings."""
        parts = self.specials.split(text) if self.specials else [text]
        return [p for part in parts for p in self.pattern.findall(part)]

    def _of_part(self, part: str) -> list[int]:
        """counts[i]: tokens of the first i characters of a part without special strings."""
        counts, base, run_base, run_at = [0], 0, 0, 0
        previous_blank = False
        for piece in self.pattern.findall(part):
            if not previous_blank:
                run_base, run_at = base, len(counts) - 1
            by_byte = self.of_piece(piece.encode())
            own = [by_byte[i] for i in accumulate(len(c.encode()) for c in piece)]
            if piece in _LONG_CONTRACTIONS:  # a cut contraction is a mark and a letter
                own[1] = 2
            at = len(counts) - 1
            counts += [base + n for n in own]
            blank = piece.isspace()
            if previous_blank and piece[0].isspace():  # a cut after the first blank leaves one run of blanks
                run = part[run_at:at + 1]
                counts[at + 1] = run_base + self.of_piece(run.encode())[-1]
            base += own[-1]
            previous_blank = blank
        return counts

    def at_every_prefix(self, text: str) -> np.ndarray:
        """counts[i]: tokens of ``text[:i]``, for every i from 0 to len(text)."""
        counts, base, at = [0], 0, 0
        for found in (self.specials.finditer(text) if self.specials else ()):
            part = self._of_part(text[at:found.start()])
            counts += [base + n for n in part[1:]]
            for cut in range(found.start() + 1, found.end()):
                counts.append(base + self.total(text[at:cut]))
            base += part[-1] + 1
            counts.append(base)
            at = found.end()
        part = self._of_part(text[at:])
        return np.array(counts + [base + n for n in part[1:]], dtype=np.int64)

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters of ``text`` that make at most ``budget`` tokens."""
        return int(np.flatnonzero(self.at_every_prefix(text) <= budget)[-1])


def doc_groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes (one row at least)."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


_LOADED: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """The counter of a vocabulary file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(Vocabulary(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts).to_pylist()
            n_tokens = []
            for first, end in doc_groups(n_bytes, GROUP_BYTES):
                n_tokens += count.totals(texts.slice(first, end - first).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = documents_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and ``counts``: element i (from 0) is the token count of the first i code points. For truncation and budgets, see below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path)
        for batch in batches:
            for i in range(batch.num_rows):  # one document at a time: the tables are larger than the texts
                counts = count.at_every_prefix(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([counts], pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return documents_of(docs).mapInArrow(run, "doc_id long, counts array<long>")


def tokens_at(counts, n_chars: int):
    """Tokens of the first ``n_chars`` code points (of the whole text if it is shorter)."""
    return F.element_at(counts, F.least(F.lit(n_chars + 1), F.size(counts)))


def chars_within(counts, budget: int):
    """The most code points that make at most ``budget`` tokens."""
    return F.size(counts) - 1 - (F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True) - 1).cast("int")
