"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Documents and items are lower-cased (A-Z only) and cut into words: runs of ASCII letters and digits and of anything beyond ASCII. A window is 13
consecutive words of an item, or all words of a shorter one. The automaton is built from the windows, each bounded by
single blanks, and walks the normalised text of a document once. Word positions are mapped back to code points of the original.

The benchmark is the side that is copied to the executors. ``ITEM_BYTES`` bounds the text that goes into one automaton; a larger
benchmark is cut into several slices and the documents pass them one after the other, so that memory stays bounded and no item is left out.

Cases: null or empty text has no words and no hit; an item without words matches nothing; a null item_id is not listed
(its windows still hit); equal items all count; repeated documents are judged one by one; empty tables work; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, quoted, written

WINDOW = 13
ITEM_BYTES = 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z; ASCII outside letters and digits to a blank; everything else as it is
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text, as lower-cased UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return raw.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


class Scanner:
    """The automaton of some items; ``hits`` finds the covered words of a text and the items found."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = WINDOW):
        owners: dict[bytes, set[int]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                owners.setdefault(window, set()).update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():  # Latin-1 gives one character to each byte of UTF-8
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (first, end) covered by windows, merged, and the ids of the items they come from."""
        if self.empty or not words:
            return [], set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(blanks, [end for end, _ in found])  # the blank after word i has number i + 1
        ranges, items = [], set()
        for end, (_, (n, ids)) in sorted(zip(ends.tolist(), found), key=lambda x: (x[0] - x[1][1][0], x[0])):
            items.update(ids)
            if ranges and end - n <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], end))
            else:
                ranges.append((end - n, end))
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as (start, end) code points of the original text."""
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


_LOWER = {c: c + 32 for c in range(65, 91)}
_SPANS = "array<struct<start:long,end:long>>"
_FOUND = f"n_words long, n_hit long, item_ids array<long>, word_spans {_SPANS}, spans {_SPANS}"


def _slices(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[tuple[int | None, str | None]], bool]]:
    """The items in slices of at most ``limit`` bytes (one item at least), read one after the other, and whether it is the last slice."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    held, size = [], 0
    for row in items.toLocalIterator():
        more = len((row.text or "").encode())
        if held and size + more > limit:
            yield held, False
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += more
    yield held, True


_BUILT: dict[int, Scanner] = {}


def _scanner(shared, size: int) -> Scanner:
    """The automaton of a broadcast slice, built once in each Python worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Scanner(shared.value, size)
    return _BUILT[shared.id]


class _Shared:
    """A broadcast with a key for the worker's cache."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def scan(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Columns ``carry`` of ``docs`` with n_words, n_hit, item_ids, word_spans (word numbers) and spans (code points), ends exclusive.

    ``docs`` needs ``text``; with several slices the found ranges of one pass are the input of the next.
    """
    spark = docs.sparkSession
    out = docs
    for number, (items, last) in enumerate(_slices(benchmark, item_bytes)):
        shared, first = _Shared(spark.sparkContext.broadcast(items)), number == 0
        keep = [c for c in docs.columns if c in carry or (not last and c == "text")]
        fields = [f for f in docs.schema.fields if f.name in keep]
        out = out.mapInArrow(_pass(shared, size, keep, first), _with(fields))
        if not last:
            out = written(out, "scan")
    return out


def _with(fields):
    from pyspark.sql.types import StructType

    found = StructType.fromDDL(_FOUND)
    return StructType([*fields, *found.fields])


def _pass(shared, size: int, keep: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared, size)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        pairs = lambda ranges: [{"start": a, "end": b} for a, b in ranges]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            before = [(None, None)] * batch.num_rows if first else list(zip(
                batch.column(batch.schema.get_field_index("word_spans")).to_pylist(), batch.column(batch.schema.get_field_index("item_ids")).to_pylist()))
            n_words, n_hit, ids, word_spans, spans = [], [], [], [], []
            for text, (old_ranges, old_ids) in zip(texts, before):
                text = text.as_py() or b""
                words = words_of(text)
                ranges, items = scanner.hits(words)
                if old_ranges:
                    ranges = merged(ranges + [(r["start"], r["end"]) for r in old_ranges])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in ranges))
                ids.append(sorted(items | set(old_ids or ())))
                word_spans.append(pairs(ranges))
                spans.append(pairs(original_spans(text.decode(), ranges)) if ranges else [])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                    pa.array(word_spans, span), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, "n_words", "n_hit", "item_ids", "word_spans", "spans"])

    return run


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row per document."""
    found = scan(documents_of(docs), benchmark)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    inner = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return scan(inner, benchmark, ("_row",)).where(~contaminated()).select("_row.*")


def brute_force(text: str | None, items: list[tuple[int | None, str | None]], size: int = WINDOW) -> tuple[int, int, list[int]]:
    """n_words, n_hit and item ids by comparing every window with every position (for tests)."""
    words = [w.encode() for w in WORD.findall((text or "").translate(_LOWER))]
    hit, ids = set(), set()
    for item, body in items:
        own = [w.encode() for w in WORD.findall((body or "").translate(_LOWER))]
        for i in range(max(1, len(own) - size + 1) if own else 0):
            window = own[i:i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j:j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    ids.update(() if item is None else (item,))
    return len(words), len(hit), sorted(ids)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
