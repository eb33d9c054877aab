"""Expected totals meet the targets; the steps equal a plain projected gradient; edge cases."""

from itertools import combinations

import numpy as np

from quietwire.llm import mixing as M

TARGETS = {"x": 0.5, "y": 0.3, "z": 0.2}


def _docs(docs_frame, n=150):
    rng = np.random.default_rng(2)
    words = {d: [f"{d}{i}" for i in range(12)] for d in "xyz"}
    rows = [(i, " ".join(rng.choice(words["xxxyz"[i % 5]], rng.integers(3, 80)))) for i in range(n)]
    labels = [(i, "xxxyz"[i % 5]) for i in range(0, n, 2)]
    return rows, labels


def test_expected_totals_meet_targets(docs_frame, spark):
    rows, labels = _docs(docs_frame)
    docs, labelled = docs_frame(*rows, more="rate tokens domain"), spark.createDataFrame(labels, "doc_id long, domain string")
    out = M.mixed(docs, labelled, TARGETS).toPandas().sort_values("doc_id")
    p, t = np.array(out["posterior"].tolist()), out["tokens"].to_numpy()
    total = (out["rate"].to_numpy() * t) @ p
    assert np.allclose(total / total.sum(), [0.5, 0.3, 0.2], atol=1e-4) and (out["rate"] >= 0).all()
    assert t.tolist() == [len(x.split()) for _, x in rows] and np.allclose(p.sum(axis=1), 1)
    best = np.array(list("xyz"))[p.argmax(axis=1)]
    assert (best == np.array(["xxxyz"[i % 5] for i in range(len(rows))])).mean() > 0.97
    assert ((out["copies"] - out["rate"]).abs() < 1).all()
    # the same steps in numpy, with the rates stored
    rate, budget = np.full(len(out), 1.0), None
    have = t @ p
    budget = (have / np.array([0.5, 0.3, 0.2])).max()
    rate *= budget / have.sum()
    for _ in range(M.STEPS):
        residual = budget * np.array([0.5, 0.3, 0.2]) - (rate * t) @ p
        if np.abs(residual).max() <= M.CLOSE * budget:
            break
        slope = (((rate > 0) * t)[:, None] * p * p).sum(axis=0)
        rate = np.maximum(0, rate + p @ (residual / slope))
    rate /= min(rate.min(), 1)  # without a budget all rates grow until the least is one
    assert np.allclose(rate, out["rate"], rtol=1e-6) and out["rate"].min() >= 1 and (out["copies"] >= 1).all()


def test_projection_keeps_rates_nonnegative(spark):
    table = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [0.0, 1.0])], "tokens long, posterior array<double>")
    start, moves = M.fitted_rates(table, [0.05, 0.95], budget=100.0)
    rates = [r.rate for r in table.select(M.rate_expression(start, moves).alias("rate")).collect()]
    assert min(rates) >= 0 and rates[0] == 0  # what only feeds the unwanted domain goes first


def test_edge_cases(docs_frame, spark):
    docs = docs_frame((1, None), (2, ""), (3, "x1 x2"), (3, "x1 x2"), (None, "y1"), more="copies")
    labelled = spark.createDataFrame([(3, "x"), (3, "y"), (77, "x"), (1, None), (2, "other")], "doc_id long, domain string")
    assert M.mixed(docs, labelled, TARGETS).count() == 5
    uniform = M.mixed(docs, labelled.limit(0), TARGETS).collect()
    assert all(np.allclose(r.posterior, [0.5, 0.3, 0.2]) for r in uniform)
    assert M.mixed(docs.limit(0), labelled, TARGETS).count() == 0
    only_empty = M.mixed(docs.where("doc_id < 3"), labelled, TARGETS).collect()
    assert [r.tokens for r in only_empty] == [0, 0] and all(r.rate == 1 for r in only_empty)
    kept = M.mixed_documents(docs, labelled, TARGETS)
    assert set(kept.columns) == set(docs.columns) | {"tokens", "rate"} and all(r.copies > 0 for r in kept.collect())


def _table(spark, confidence, n=400):
    """Four domains of documents whose posterior of their own domain is ``confidence``."""
    rng = np.random.default_rng(7)
    p = np.full((n, 4), (1 - confidence) / 3)
    p[np.arange(n), np.arange(n) % 4] = confidence
    return spark.createDataFrame([(int(t), q) for t, q in zip(rng.integers(1, 300, n), p.tolist())], "tokens long, posterior array<double>")


def _least_distance(directions, goal):
    """The distance of ``goal`` from all nonnegative mixes of a few directions, by every choice of those in use."""
    best = np.linalg.norm(goal)
    for size in range(1, len(directions) + 1):
        for used in combinations(directions, size):
            amount = np.linalg.lstsq(np.array(used).T, goal, rcond=None)[0]
            if amount.min() >= -1e-12:
                best = min(best, np.linalg.norm(np.array(used).T @ amount - goal))
    return best


def test_soft_posteriors_reach_what_can_be_reached(spark):
    share = np.array([0.55, 0.15, 0.15, 0.15])
    for confidence in (0.95, 0.7, 0.6, 0.5, 0.4):
        table = _table(spark, confidence)
        start, moves, residual = M.fit(table, share.tolist())
        rows = table.select("tokens", "posterior", M.rate_expression(start, moves).alias("rate")).toPandas()
        t, p, rate = rows["tokens"].to_numpy(float), np.array(rows["posterior"].tolist()), rows["rate"].to_numpy()
        budget = ((t @ p) / share).max()
        least = _least_distance(np.unique(p, axis=0), share)
        reached = np.linalg.norm((rate * t) @ p / budget - share)
        assert reached <= least + 1e-5 and rate.min() >= 0 and rate.max() < 20, confidence
        assert abs(residual - np.abs((rate * t) @ p / budget - share).max()) < 1e-9
        assert (least < 1e-9) == (residual < 1e-5)


def test_uninformative_posteriors_keep_the_common_rate(spark):
    table = _table(spark, 0.25)
    start, moves, residual = M.fit(table, [0.55, 0.15, 0.15, 0.15])
    rates = [r.rate for r in table.select(M.rate_expression(start, moves).alias("rate")).collect()]
    assert np.allclose(rates, start, rtol=1e-4) and start >= 1 and residual > 0.1


def _plain_projected_gradient(t, p, target, start, steps=200_000):
    """Stored rates, the same safe length in every step."""
    rate, length = np.full(len(t), start), 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(steps):
        new = np.maximum(0, rate + length * (p @ (target - (rate * t) @ p)))
        if np.abs(new - rate).max() < 1e-13:
            break
        rate = new
    return rate


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(11)
    p = rng.dirichlet([0.6, 0.6, 0.6], 300)
    t = rng.integers(1, 200, 300)
    table = spark.createDataFrame([(int(a), q) for a, q in zip(t, p.tolist())], "tokens long, posterior array<double>")
    for share in ([0.36, 0.33, 0.31], [0.6, 0.25, 0.15], [0.9, 0.06, 0.04]):  # none, some and most rates held at zero
        start, moves, residual = M.fit(table, share, budget=float(t.sum()))
        rate = np.array([r.rate for r in table.select(M.rate_expression(start, moves).alias("rate")).collect()])
        target = t.sum() * np.array(share)
        want = _plain_projected_gradient(t.astype(float), p, target, start)
        miss, least = np.linalg.norm((rate * t) @ p - target), np.linalg.norm((want * t) @ p - target)
        assert rate.min() >= 0 and abs(miss - least) < 1e-5 * t.sum() and len(moves) <= M.STEPS, share
        if share[0] == 0.36:
            assert len(moves) == 1 and np.allclose(rate, want, rtol=1e-6)  # moves that hold nothing add up


def test_column_names_with_dots_and_ties(docs_frame, spark):
    rows, labels = _docs(docs_frame, 60)
    docs = docs_frame(*rows, *rows[:5]).withColumns({"a.b": M.F.lit(1), "c`d": M.F.lit(2)})
    kept = M.mixed_documents(docs, spark.createDataFrame(labels, "doc_id long, domain string"), TARGETS)
    assert {"a.b", "c`d"} <= set(kept.columns) and kept.count() == docs.count()
    assert kept.groupBy("doc_id").agg(M.F.count_distinct("rate", "copies").alias("n")).where("n > 1").count() == 0
