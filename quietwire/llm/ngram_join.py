"""Near-duplicate join on word shingles: MinHash blocks, Bayesian pruning of pairs, exact Jaccard for what is left.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; a shingle is five consecutive words (all words of a shorter text).
Texts with the same words in the same order are copies of one *text class*; only one representative of a class is compared.

1. One pass over the texts gives a 128-bit digest of the word sequence and 32 block keys of four MinHash values each. At a similarity of 0.8 a pair
   shares no block with a probability of about 5e-8.
2. Every representative is tied to the smallest one of each of its blocks; connected components of these ties hold every pair that shares
   a block. No pairs are listed: a block of n texts makes n rows.
3. Components are compared in units of at most two times ``BLOCK`` texts. Inside a unit the MinHash values are compared in
   groups of sixteen; a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls
   below ``TOLERANCE``. Pairs that survive all 128 values are decided by the exact Jaccard similarity of their shingle sets.
4. A unit returns the number of links of each text and one tie to the smallest text it is connected with, so that dense groups of near
   copies return rows in proportion to their texts, while no link is lost. The ties' components are the classes.

Cases: texts without words (null, empty, marks only) are copies of one another and link to nothing else; repeated rows are copies;
rows with a null doc_id are compared like others, but never represent a class that has a doc_id; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.components import components
from quietwire.llm.tables import documents_of, with_group, written
from quietwire.llm.word_hashes import buffers, groups, mix, per_text, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512

_ADD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(_ADD) | np.uint64(1)


def signatures(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (n texts x 128, 32 bit) of the shingles of each text."""
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rows = owner[first]
        with np.errstate(over="ignore"):
            for j in range(HASHES):
                out[rows, j] = np.minimum.reduceat(((values + _ADD[j]) * _TIMES[j] >> np.uint64(32)).astype(np.uint32), first)
    return out


def sequence_digests(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of the word sequence of each text."""
    place = np.zeros(len(owner), np.uint64)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = (np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = mix(hashes + place * np.uint64(0xA0761D6478BD642F))
        two = mix((hashes ^ np.uint64(0xE7037ED1A0B428DB)) + place * np.uint64(0x8EBC6AF09C88C6E3))
    return per_text(one, owner, n, np.add, 0), per_text(two, owner, n, np.add, 0)


def block_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band number is part of it."""
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), (len(signature), BANDS)).copy()
        for r in range(ROWS):
            keys = mix(keys + signature[:, r::ROWS].astype(np.uint64))
    return keys


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = buffers(batch.column(1))
            for first, end in groups(bounds):
                n = end - first
                hashes, owner = words(raw, bounds[first:end + 1])
                one, two = sequence_digests(hashes, owner, n)
                count = np.bincount(owner, minlength=n)
                keys = block_keys(signatures(*shingles(hashes, owner, size), n)).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(count, pa.int64()), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), flat], names=["doc_id", "h", "n_words", "one", "two", "keys"])

    return run


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 16, 32, ... compared values: the fewest matches at which P(similarity >= threshold | matches) is at least ``tolerance``.

    With a uniform prior the posterior is Beta(matches + 1, misses + 1); its upper tail is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(k+1, n-k+1) >= t) = P(Binomial(n+1, t) <= k)
        tail, k = 0.0, 0
        while True:
            tail += comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k)
            if tail >= tolerance:
                break
            k += 1
        out.append(k)
    return tuple(out)


def surviving_pairs(signature: np.ndarray, split: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that Bayesian pruning leaves: all of them, or with ``split`` only those across it."""
    n = len(signature)
    least = least_matches(threshold, tolerance)
    left, right = [], []
    for i in range(split if split else n - 1):  # one text against all later ones
        others = np.arange(split if split else i + 1, n)
        matches = np.zeros(len(others), np.int32)
        for step, enough in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (signature[others, part] == signature[i, part]).sum(axis=1, dtype=np.int32)
            keep = matches >= enough
            others, matches = others[keep], matches[keep]
            if not len(others):
                break
        if len(others):
            left.append(np.full(len(others), i))
            right.append(others)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by the sizes of the intersections of the (sorted, distinct) shingle sets."""
    sizes = np.array([len(s) for s in sets])
    common = np.zeros(len(left), np.int64)
    used = np.unique(np.r_[left, right])
    if not len(used):
        return np.zeros(0, bool)
    flat = np.concatenate([sets[i] for i in used])
    vocabulary, number = np.unique(flat, return_inverse=True)
    held = np.repeat(np.arange(len(used)), sizes[used])
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    if len(left) * sizes[used].mean() * 400 > float(len(used)) ** 2 * len(vocabulary):  # dense: rows of a 0/1 matrix, some columns at a time
        product = np.zeros((len(used), len(used)), np.float32)
        width = max(1, (1 << 22) // len(used))
        order = np.argsort(number, kind="stable")
        number, held = number[order], held[order]
        for column in range(0, len(vocabulary), width):
            a, b = np.searchsorted(number, [column, column + width])
            block = np.zeros((len(used), width), np.float32)
            block[held[a:b], number[a:b] - column] = 1
            product += block @ block.T
        common = product[at[left], at[right]].astype(np.int64)
    else:
        for i in np.unique(left):
            mine = np.flatnonzero(left == i)
            partners = right[mine]
            joined = np.concatenate([sets[j] for j in partners])
            place = np.minimum(np.searchsorted(sets[i], joined), max(0, sizes[i] - 1))
            same = sets[i][place] == joined if sizes[i] else np.zeros(len(joined), bool)
            common[mine] = np.bincount(np.repeat(np.arange(len(partners)), sizes[partners]), weights=same, minlength=len(partners)).astype(np.int64)
    # common / union >= threshold in whole numbers
    scale = 10_000
    return common * scale >= round(threshold * scale) * (sizes[left] + sizes[right] - common)


def smallest_connected(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each one's connected group."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def features(texts: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingle sets (sorted) and MinHash values of texts."""
    raw, bounds = buffers(texts)
    sets, signature = [], []
    for first, end in groups(bounds):
        values, owner = shingles(*words(raw, bounds[first:end + 1]), size)
        signature.append(signatures(values, owner, end - first))
        cuts = np.searchsorted(owner, np.arange(end - first + 1))
        sets += [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return sets, np.concatenate(signature) if signature else np.zeros((0, HASHES), np.uint32)


def compare_unit(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], signature: np.ndarray, threshold: float, tolerance: float):
    """(node, links, smallest connected node) inside one unit; if some have ``side`` 1, only pairs across the two sides count."""
    order = np.lexsort((nodes, side))
    order = order[np.r_[True, nodes[order][1:] != nodes[order][:-1]]]  # one row for each node
    nodes, side, signature, sets = nodes[order], side[order], signature[order], [sets[i] for i in order]
    split = int((side == 0).sum()) if side.any() else 0
    left, right = surviving_pairs(signature, split, threshold, tolerance)
    linked = exact_links(sets, left, right, threshold)
    left, right = left[linked], right[linked]
    links = np.bincount(left, minlength=len(nodes)) + np.bincount(right, minlength=len(nodes))
    by_node = np.argsort(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[by_node] = np.arange(len(nodes))
    root = nodes[by_node][smallest_connected(len(nodes), rank[left], rank[right])[rank]]
    return nodes, links, root


def _compare(size: int, threshold: float, tolerance: float):
    """Over rows (unit, side, node, text) sorted by unit: what is held is one unit and one batch."""
    def done(held: list[tuple]) -> pa.RecordBatch | None:
        if sum(len(h[0]) for h in held) < 2:
            return None
        nodes, side, signature = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
        nodes, links, root = compare_unit(nodes, side, [s for h in held for s in h[2]], signature, threshold, tolerance)
        linked = links > 0
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(links[linked].astype(np.int64)), pa.array(root[linked])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None
        for batch in batches:
            ids, side, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sets, signature = features(batch.column(3), size)
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if held and ids[a] != unit:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                unit = ids[a]
                held.append((nodes[a:b], side[a:b], sets[a:b], signature[a:b]))
        if held and (out := done(held)) is not None:
            yield out

    return run


def near_classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, rep_id, n_copies, n_links, kept, text_hash.

    ``rep_id`` is the smallest doc_id of the document's text class (same word sequence), ``n_copies`` the size of that class, ``n_links`` the number of
    other text classes whose shingle sets are similar to at least ``threshold``; ``class_id`` is the smallest doc_id of all text classes that links
    connect. ``kept`` marks one document of each.
    """
    plain = documents_of(docs).withColumn("h", F.xxhash64("text"))
    sketch = written(plain.mapInArrow(_sketch(size), "doc_id long, h long, n_words long, one long, two long, keys array<long>")
                     .withColumn("row", F.monotonically_increasing_id()), "sketch")
    text_class = ["n_words", "one", "two"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row", "h")).alias("best")
    nodes = written(sketch.groupBy(*text_class).agg(best, F.count("*").alias("n_copies"), F.first("keys").alias("keys"))
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")
    # blocks of two or more text classes: each member is tied to the smallest
    member = nodes.where("n_words > 0").select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most").select("key", "pivot")
    ties = member.join(shared, "key").where("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    grouped = components(ties)
    # a component of several blocks is compared block by block: a text of block m takes part in the units of (m, k) for every k
    sized = with_group(grouped, "root", "node", n=(F.count("*"), F.sum)).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = (sized.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .join(nodes.select("node", F.col("best.doc_id").alias("doc_id"), F.col("best.h").alias("h")), "node"))
    same = plain["doc_id"].eqNullSafe(dealt["doc_id"]) & (plain["h"] == dealt["h"])
    placed = plain.join(dealt, same).select("node", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "text")
    unit = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit")
    units = placed.select(unit, (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "text")
    found = written(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(size, threshold, tolerance), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = components(found.where("node > root").select(F.col("node").alias("a"), F.col("root").alias("b"))).join(nodes.select("node", "best"), "node")
    classes = with_group(linked, "root", "node", first=(F.min("best"), F.min)).select("node", "first")
    per_class = (nodes.join(links, "node", "left").join(classes, "node", "left")
                 .select(*text_class, "best", F.coalesce("first", "best").alias("first"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return sketch.drop("keys").join(per_class, text_class).select(
        sketch["doc_id"], F.col("first.doc_id").alias("class_id"), F.col("best.doc_id").alias("rep_id"), "n_copies", "n_links", (F.col("row") == F.col("first.row")).alias("kept"), F.col("h").alias("text_hash"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class, with all their columns (rows equal in doc_id and text are one document)."""
    judged = near_classes(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("kept").alias("_stays")).where("not _stays")
    same = docs["doc_id"].cast("long").eqNullSafe(judged["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == judged["_hash"])
    return docs.join(judged, same, "left_anti")
