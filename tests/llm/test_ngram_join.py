"""Links and classes against all pairs, pruning, exact intersections, and components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quietwire.llm import ngram_join as J
from quietwire.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, size=5, threshold=0.8):
    """{row number: (class, representative, links)} by comparing all text classes."""
    order = lambda i: (i is None, i or 0)
    words = [tuple(WORD.findall((t or "").translate(LOW))) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        first[w] = min(first.get(w, i), i, key=order) if w in first else i
    sets = {w: {w[k:k + size] for k in range(max(1, len(w) - size + 1))} if w else set() for w in first}
    links, root = dict.fromkeys(first, 0), {w: w for w in first}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    classes = list(first)
    for k, a in enumerate(classes):
        for b in classes[k + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    members = {}
    for w in classes:
        members.setdefault(find(w), []).append(first[w])
    return [(i, min(members[find(w)], key=order), first[w], links[w]) for (i, _), w in zip(rows, words)]


def family(rng, n, length, edits, start):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randint(0, 9999)}"
        out.append((start + k, " ".join(copy)))
    return out


def test_classes_equal_all_pairs(docs_frame):
    rng = random.Random(5)
    rows = family(rng, 40, 150, 5, 0) + family(rng, 30, 60, 2, 100) + family(rng, 25, 400, 14, 200) + [
        (300, None), (301, ""), (302, "?!"), (303, "one two"), (304, "One, TWO"), (305, "one two three"), (306, "a b c d e"), (None, "one two"), (303, "one two")]
    docs = docs_frame(*rows, more="node keys class_id h").repartition(3)
    for block in (512, 8):  # whole components, and components cut into blocks
        got = sorted(((r.doc_id, r.class_id, r.rep_id, r.n_links) for r in J.near_classes(docs, block=block).collect()), key=str)
        assert got == sorted(brute(rows), key=str)
    kept = [r for r in J.near_classes(docs).collect() if r.kept]
    assert len(kept) == len({r.class_id for r in kept}) == len({x[1] for x in brute(rows)})


def test_one_of_each_class(docs_frame):
    rng = random.Random(6)
    rows = family(rng, 12, 80, 1, 0) + [(50, "alone in the world"), (51, "Alone, in the world!")]
    docs = docs_frame(*rows, more="node")
    kept = J.one_of_each_class(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c, _, _ in brute(rows)}
    assert J.near_classes(docs.limit(0)).count() == 0 and J.one_of_each_class(docs.limit(0)).count() == 0


@pytest.mark.parametrize("split", [0, 20])
def test_unit_links_equal_all_pairs_dense_and_sparse(split):
    rng = random.Random(7)
    texts = [t for _, t in family(rng, 30, 120, 6, 0)] + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(20)]
    sets, signature = J.features(pa.array(texts), 5)
    left, right = J.surviving_pairs(signature, split, 0.8, 1e-6)
    linked = J.exact_links(sets, left, right, 0.8)
    got = set(zip(left[linked].tolist(), right[linked].tolist()))
    true = {(i, j) for i in range(50) for j in range(i + 1, 50) if (not split or i < split <= j)
            and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert got == true and true


def test_pruning_bound_is_the_posterior():
    least = J.least_matches(0.8, 1e-6)
    assert len(least) == 8 and list(least) == sorted(least)
    grid = np.linspace(0, 1, 200_001)
    for step, k in enumerate(least):
        n = 16 * (step + 1)
        weight = lambda m: np.where(grid > 0, grid, 1e-300) ** m * (1 - grid) ** (n - m)  # noqa: B023,E731
        tail = lambda m: weight(m)[grid >= 0.8].sum() / weight(m).sum()
        assert tail(k) >= 0.9e-6 and (k == 0 or tail(k - 1) < 1.1e-6)


def test_components_of_chains_rings_and_hubs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 900)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(7)}, **{500 + i: 500 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
