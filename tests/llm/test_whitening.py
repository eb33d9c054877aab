"""Against a dense eigendecomposition and Python's integers, hard spectra of the solver, and odd vectors."""

import math

import numpy as np
import pytest

from quietwire.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, x binary, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, None, None, 1) for i, v in vectors], SCHEMA)


def brute(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    y = exact.astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, (exact ** 2).sum(axis=1), y, values[::-1], axes[:, ::-1]


def test_whitened_rows_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(12) * np.linspace(2, 0.2, 12)).tolist()) for i in range(300)]
    vectors += [(None, vectors[0][1]), (7, vectors[0][1])]
    bad = [(1000, None), (1001, [float("nan")] * 12), (1002, [1.0, None] * 6), (1003, [float("inf")] + [0.0] * 11), (1004, [1.0] * 5), (1005, []), (1006, [3e38] * 12)]
    n, deviation, y, values, axes = brute(vectors)
    rows = W.whitened(frame(spark, vectors + bad).repartition(5)).collect()
    assert len(rows) == 8 * len(vectors) and {r.n for r in rows} == {n}
    held = {}
    for r in rows:
        held.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    projected = y @ axes[:, :8] / np.sqrt(values[:8])
    sign = {}
    for (vec, _), own, dev in zip(vectors, projected, deviation):
        got = held[(vec, int(dev))]
        for k in range(8):
            value = min(got[k + 1], key=lambda z: abs(abs(z) - abs(own[k])))
            assert abs(abs(value) - abs(own[k])) < 1e-8
            sign.setdefault(k, set()).add(value * own[k] >= 0 or abs(own[k]) < 1e-6)
    assert all(len(s - {True}) == 0 or len(s - {False}) == 0 for s in sign.values())
    for r in rows:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_few_dimensions_no_variance_and_no_rows(spark):
    rows = W.whitened(frame(spark, [(i, [float(i), -2.0 * i]) for i in range(4)])).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True)}
    assert {round(r.explained, 12) for r in rows if r.component == 1} == {1.0}
    rows = W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(0, None, None, None)} and len(rows) == 4
    assert W.whitened(frame(spark, [(1, None), (2, [])])).collect() == [] == W.whitened(frame(spark, [])).collect()


def test_deviation_stays_exact_beyond_longs(spark):
    big = float(2 ** 39)
    vectors = [(i, [big if i % 2 else -big, float(i)]) for i in range(40)]
    n, deviation, *_ = brute(vectors)
    got = {r.vec_id: r.deviation for r in W.whitened(frame(spark, vectors)).collect()}
    assert got == {i: (int(d) if d < 1 << 63 else None) for i, d in enumerate(deviation)} and None in got.values()


@pytest.mark.parametrize("matrix", [
    np.diag([5.0, 5, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1]), np.diag(np.linspace(1, 2, 300)), np.zeros((6, 6)), np.diag(10.0 ** -np.arange(40.0)),
    (lambda b: b @ b.T)(np.random.default_rng(1).standard_normal((200, 3)))], ids=["ties", "close", "zero", "steep", "rank 3"])
def test_solver_reaches_double_precision(matrix):
    calls = []
    values, vectors = W.leading_pairs(lambda z: calls.append(z.shape) or matrix @ z, len(matrix), 8)
    expected = np.linalg.eigvalsh(matrix)[::-1][:8]
    scale = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * scale
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
    assert len(calls) < 200


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    matrix = np.diag(np.r_[-3.0, np.linspace(1, 4, 19)])
    right = rng.standard_normal((20, 3))
    assert np.allclose(matrix @ W.minres(lambda z: matrix @ z, right, 40, 1e-12), right, atol=1e-9)
