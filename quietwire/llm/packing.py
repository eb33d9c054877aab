"""Packing token sequences by a plan over length counts: best fit decides for counts of equal lengths, documents then take planned slots by rank.

1. *Pieces.* A document's token ids and an end id are one piece; only documents longer than the limit are cut, from the end, so that the first
   piece may be shorter.
2. *Plan.* The counts of pieces by length (as many numbers as the limit) are placed by best fit, longest first: a class is a run of sequences with equal
   contents, and a length moves whole classes at a time. The plan is a list of slots (length, first rank, first sequence, pieces per sequence, offset); its
   size depends on the limit alone: a class is split at most twice per length, and the different lengths within one sequence add up to the limit.
3. *Ranks.* Pieces are dealt out by (length, hash of the row), a length of n pieces to about root n parts of root n pieces; a piece's rank is its place there
   plus the counts of the parts before. No task gets all pieces of a frequent length. Rank and length name the slot.

Token ids come from the vocabulary file. Where its merges are in the order of its ids, the byte-level library gives the same ids several times as fast and
is used; texts with special strings, and other vocabularies, go through the file's own library. Texts beyond ``PART_CHARS`` are encoded in parts, cut where
a blank starts a piece in any case.

Cases: null text is empty (one piece with the end id); repeated rows and equal or null doc_ids are packed row by row; pieces of equal length are interchangeable and
ordered by their stored row number; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, written
from quietwire.llm.token_counts import PATTERN, _byte_letters, doc_groups

LIMIT = 1024
#: Fixed value: the id that ends every document.
END_ID = 2
GROUP_BYTES = 4 << 20
PART_CHARS = 1 << 20
#: Ranks within a length stay below two to this power.
RANK_BITS = 44
#: A blank behind a letter and before a letter starts a piece, whatever stands around it.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


class Encoder:
    """Token ids of texts under a byte-level vocabulary file, as the file's library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        self.special = [t["content"] for t in saved["added_tokens"]]
        self.quick = self._quick(saved)

    def _quick(self, saved: dict):
        """The byte-level library with the same ranks, or None where ids do not follow the merges."""
        import tiktoken

        vocabulary = {t: i for t, i in saved["model"]["vocab"].items() if t not in self.special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in saved["model"]["merges"]]
        order = [vocabulary.get(m, -1) for m in merges]
        singles = len(vocabulary) - len(merges)
        if order != list(range(singles, singles + len(merges))):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS:
            found = _CUT.search(text, at + PART_CHARS)
            if not found:
                break
            yield text[at:found.start()]
            at = found.start()
        yield text[at:] if at else text

    def ids(self, text: str) -> np.ndarray:
        plain = self.quick is not None and not any(s in text for s in self.special)
        encode = self.quick.encode_to_numpy if plain else lambda part, **_: np.array(self.library.encode(part, add_special_tokens=False).ids, np.uint32)
        found = [encode(part, disallowed_special=()) for part in self._parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (little-endian unsigned 32-bit numbers) of every document's pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(vocabulary_path).ids, np.array([end_id], "<u4")
        for batch in batches:
            for first, stop in doc_groups(pc.binary_length(batch.column(1)).to_pylist(), GROUP_BYTES):
                owner, number, start, ids = [], [], [], []
                for row, text in enumerate(batch.column(1).slice(first, stop - first).to_pylist(), first):
                    tokens = np.concatenate([ids_of(text).astype("<u4", copy=False), end])
                    cuts = range(len(tokens) % limit or limit, len(tokens) + 1, limit) if len(tokens) > limit else [len(tokens)]
                    for nth, cut in enumerate(cuts):
                        begin = cuts[nth - 1] if nth else 0
                        owner.append(row)
                        number.append(nth)
                        start.append(begin)
                        ids.append(tokens[begin:cut].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return documents_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


@dataclass(frozen=True)
class Slots:
    """Pieces of one length with ranks from ``rank`` on: ``each`` of them in every sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[Slots]:
    """Best fit, longest pieces first, over counts of pieces by length: every piece goes into the fullest sequence that has room.

    ``open_[room]`` lists runs (first sequence, how many) of sequences that have ``room`` left.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, many: int, each: int, room: int) -> None:
            nonlocal rank, left
            slots.append(Slots(length, rank, first, each, limit - room))
            open_[room - each * length].append((first, many))
            rank, left = rank + many * each, left - many * each

        for room in sorted(r for r, runs in open_.items() if r >= length and runs):
            runs, open_[room] = open_[room], []
            each = room // length
            for first, many in runs:
                filled = min(many, left // each)
                if filled:
                    place(first, filled, each, room)
                if filled < many and left:  # fewer than fill one more sequence
                    place(first + filled, 1, left, room)
                    filled += 1
                if filled < many:
                    open_[room].append((first + filled, many - filled))
        each = limit // length
        for many, held in ((left // each, each), (1, left % each)):
            if many and held:
                place(sequences, many, held, limit)
                sequences += many
    return slots


def placed(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` (with a ``length`` of 1 to ``limit``) and the ``sequence_id`` and ``offset`` of each; the rows are stored once."""
    kept = rows.columns
    stored = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # at most ``limit`` rows: the histogram, and how many tiles each length is dealt to
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, limit)
    tiles = stored.sparkSession.createDataFrame([(k, math.isqrt(n - 1) + 1) for k, n in counts.items()], "length long, _tiles long")
    tiled = stored.join(F.broadcast(tiles), "length").withColumn("_tile", F.pmod(F.xxhash64("_row"), "_tiles")).drop("_tiles")
    counted = tiled.groupBy("length", "_tile").agg(F.count("*").alias("_n"))
    before = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_tile")) - F.col("_n"))
    own = Window.partitionBy("length", "_tile").orderBy("_row")
    ranked = tiled.withColumn("_rank", F.row_number().over(own) - 1).join(before.select("length", "_tile", "_before"), ["length", "_tile"])
    ranked = ranked.select(*kept, (F.col("_rank") + F.col("_before")).alias("_rank"))
    slots = sorted(slots, key=lambda s: (s.length, s.rank))
    table = np.array([(s.length, s.rank, s.sequence, s.each, s.offset) for s in slots], np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << RANK_BITS) + table[:, 1]  # in order: the last slot that starts at or before a rank is the rank's
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            slot = table[np.searchsorted(key, (batch.column("length").to_numpy() << RANK_BITS) + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(slot[:, 2] + nth // slot[:, 3]), pa.array(slot[:, 4] + nth % slot[:, 3] * slot[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = rows.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return placed(pieces(docs, vocabulary_path, limit, end_id), limit)


def packing_report(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """As ``packed``, with the checksum ``ids_crc32`` of each piece in place of its ids, which then need not move."""
    checked = pieces(docs, vocabulary_path, limit, end_id).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return placed(checked, limit)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces: at most ``limit`` ids in a row, in the order of their offsets."""
    held = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_held"))
    return held.select("sequence_id", F.aggregate("_held", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))
