"""Mixing documents to target weights of domains, when the domain of a document is only known with some probability.

1. *Posteriors.* A softmax classifier over pooled index vectors of words, fitted to a labelled table (doc_id, domain), gives each
   document the probabilities of the domains; short texts stay close to the shares of the labelled table.
2. *Rates.* A document of t tokens and posteriors p adds rate * t * p[k] tokens to domain k in expectation. The squared distance of these totals from the
   targets is lowered by scaled projected-gradient steps on the rates of all documents: rate = max(0, rate + p . move), from one common starting rate.
   The gradient of a document is p . residual, which depends on the totals only, so a step is one aggregation to a row of sums (one for each pair of
   domains) and no rate is stored: the rates are an expression of the posteriors and the moves so far, and moves that hold no rate at zero add up to one.
   A move is the residual scaled by the inverse curvature of the rates above zero, halved until the distance falls; if it does not, the plain gradient
   is taken at the length of the largest curvature, at which every step lowers the distance. So the rates settle however soft the posteriors are.
   Targets beyond any mix of the posteriors are approached as far as possible, and the distance that remains is logged.
3. *Copies.* The whole part of the rate, and one more if a hash of the document falls below the rest. Expected totals are those of the rates.

Tokens are words (runs of letters, digits and non-ASCII characters). Unless a budget in tokens is given, the mix only repeats: the budget is the smallest that
asks no domain for less than it has, and all rates grow by one factor until the smallest is one, which keeps the shares and takes every document
at least once. Where the targets hold some rates at zero (or below ``FAINT``) documents must go, and the rates are left as they are.
Targets of domains that hold no tokens cannot be met and are shared out over the others.

Cases: null and empty texts have no tokens, rate and copies of the starting rate; labels that are null, not among the targets, or of unknown documents
are ignored; a document with several labelled domains counts for each; without usable labels the posteriors are the target weights; repeated rows
get equal rates; an empty table gives an empty result; a clashing column name is replaced by the new column.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, quoted, written
from quietwire.llm.word_hashes import buffers, groups, mix, words

DIMENSIONS = 64
SAMPLE = 20_000
PRIOR_WORDS = 4.0
STEPS = 40
CLOSE = 1e-8
#: Added to the curvature, as a share of all tokens, so that it can be inverted.
RIDGE = 1e-10
#: Scaled steps shorter than this give way to the plain gradient.
SHORTEST = 0.05
#: A smaller least rate counts as none: the budget is not multiplied by more than its inverse.
FAINT = 1e-3
SEED = 5
_log = logging.getLogger(__name__)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens, features): the mean of fixed random signs of a text's words, pulled to zero by ``PRIOR_WORDS`` words without sign."""
    for batch in batches:
        raw, bounds = buffers(batch.column(1))
        for first, end in groups(bounds, 1 << 19):
            n = end - first
            hashes, owner = words(raw, bounds[first:end + 1])
            sums = np.zeros((n, DIMENSIONS), np.float32)
            for at in range(0, len(hashes), 1 << 16):
                part, mine = mix(hashes[at:at + (1 << 16)]), owner[at:at + (1 << 16)]
                signs = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                sums[mine[heads]] += 2 * np.add.reduceat(signs, heads) - np.diff(np.r_[heads, len(mine)])[:, None]
            tokens = np.bincount(owner, minlength=n)
            features = sums / (tokens + PRIOR_WORDS).astype(np.float32)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIMENSIONS, pa.int32()), pa.array(features.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(tokens, pa.int64()), lists], names=["doc_id", "tokens", "features"])


def fit_softmax(features: np.ndarray, label: np.ndarray, n_domains: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a softmax classifier, by gradient steps with momentum; each domain starts at its share of the labels."""
    share = (np.bincount(label, minlength=n_domains) + 0.5) / (len(label) + 0.5 * n_domains)
    weights, bias = np.zeros((features.shape[1], n_domains)), np.log(share)
    speed, drift = np.zeros_like(weights), np.zeros_like(bias)
    truth = np.eye(n_domains)[label]
    for _ in range(steps):
        error = (_softmax(features @ weights + bias) - truth) / len(label)
        speed = 0.9 * speed - 8.0 * (features.T @ error + 1e-5 * weights)
        drift = 0.9 * drift - 0.5 * error.sum(axis=0)
        weights, bias = weights + speed, bias + drift
    return weights, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], weights: list[float], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, posterior): the probabilities of ``domains`` for each document, fitted to about ``sample`` labelled rows."""
    pooled = written(documents_of(docs).mapInArrow(_pool, "doc_id long, tokens long, features array<float>"), "pooled")
    known = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
    cut = int(min(1.0, sample / max(known.count(), 1)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    rows = pooled.join(chosen, "doc_id").groupBy("doc_id", "domain").agg(F.first("features").alias("features")).toPandas().sort_values(["doc_id", "domain"])
    if len(rows):
        number = {d: i for i, d in enumerate(domains)}
        matrix, bias = fit_softmax(np.array(rows["features"].tolist(), np.float64), rows["domain"].map(number).to_numpy(np.int64), len(domains))
    else:
        matrix, bias = np.zeros((DIMENSIONS, len(domains))), np.log(np.maximum(weights, 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            p = _softmax(values @ matrix + bias)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "tokens", "posterior"])

    return pooled.mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def _gain(move: np.ndarray) -> Column:
    """What a move adds to the rate of a document before it is projected."""
    return sum((F.col("posterior")[k] * float(m) for k, m in enumerate(move)), F.lit(0.0))


def rate_expression(start: float, moves: list[np.ndarray]) -> Column:
    """The rate after all ``moves``: each adds its posterior-weighted sum and projects to zero or more."""
    rate = F.lit(float(start))
    for move in moves:
        rate = F.greatest(F.lit(0.0), rate + _gain(move))
    return rate


def fit(table: DataFrame, weights: list[float], budget: float | None = None, steps: int = STEPS) -> tuple[float, list[np.ndarray], float]:
    """(start, moves, residual): what ``rate_expression`` takes, and the largest distance from a target as a share of the budget.

    ``table`` has tokens and posterior; one aggregation is run for each trial of a step.
    """
    count = len(weights)
    share = np.array(weights, float) / sum(weights)
    mass = [F.col("tokens") * F.col("posterior")[k] for k in range(count)]
    upper = [(k, m) for k in range(count) for m in range(k, count)]

    def sums(start: float, moves: list[np.ndarray], gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
        """After the last of ``moves``: expected tokens of each domain, curvature of the rates above zero, and how many rates that move holds at zero; tokens
        times squared changes that the plain ``gradient`` would have made instead of it."""
        rates = table.withColumn("_before", rate_expression(start, moves[:-1])).withColumn("_free", F.col("_before") + _gain(moves[-1]))
        rates = rates.withColumn("_rate", F.greatest(F.lit(0.0), "_free")).withColumn("_plain", F.greatest(-F.col("_before"), _gain(gradient)))
        free = F.when(F.col("_rate") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        got = rates.agg(F.count_if(F.col("_free") < 0).alias("held"), F.sum(F.col("tokens") * F.col("_plain") * F.col("_plain")).alias("plain"),
                        *[F.sum(F.col("_rate") * m).alias(f"s{k}") for k, m in enumerate(mass)],
                        *[F.sum(free * mass[k] * F.col("posterior")[m]).alias(f"h{k}_{m}") for k, m in upper]).first()
        curve = np.zeros((count, count))
        for k, m in upper:
            curve[k, m] = curve[m, k] = got[f"h{k}_{m}"] or 0.0
        return np.array([got[f"s{k}"] or 0.0 for k in range(count)]), curve, got["held"], got["plain"] or 0.0

    still = np.zeros(count)
    have, curve, _, _ = sums(1.0, [still], still)
    tokens = float(have.sum())
    if tokens == 0:
        return 1.0, [], 0.0
    share = np.where(have > 0, share, 0)
    share = share / share.sum() if share.sum() else have / tokens
    if budget is None:
        asked = share > 0
        budget = float((have[asked] / share[asked]).max())
    target, start, scale = budget * share, budget / tokens, budget * tokens ** 0.5
    sure = 1 / float(np.linalg.eigvalsh(curve)[-1])
    #: moves that held some rate at zero, and the sum of those since
    settled, open_move, reached = [], still, start * have
    for _ in range(steps):
        residual = target - reached
        if np.abs(residual).max() <= CLOSE * budget:
            break
        distance, scaled, length = float(residual @ residual), np.linalg.solve(curve + RIDGE * tokens * np.eye(count), residual), 1.0
        base = settled + ([open_move] if open_move.any() else [])
        while True:
            move = length * scaled if length >= SHORTEST else sure * residual
            then, rising, held, plain = sums(start, [*base, move], sure * residual)
            if plain ** 0.5 <= CLOSE * scale * sure or length < SHORTEST:
                break
            if float((target - then) @ (target - then)) <= distance - 2e-4 * float(residual @ (then - reached)):
                break
            length = length / 2
        if plain ** 0.5 <= CLOSE * scale * sure:  # the projected gradient was close to nothing before this move, which is not made
            break
        settled, open_move = (settled + [open_move + move], still) if held else (settled, open_move + move)
        reached, curve = then, rising
    else:
        _log.warning("rates not settled after %d steps", steps)
    residual = float(np.abs(target - reached).max() / budget)
    if residual > 10 * CLOSE:
        _log.warning("expected tokens miss a target by %.3g of the budget: no mix of the posteriors is nearer", residual)
    return start, settled + ([open_move] if open_move.any() else []), residual


def fitted_rates(table: DataFrame, weights: list[float], budget: float | None = None, steps: int = STEPS) -> tuple[float, list[np.ndarray]]:
    """(start, moves) for ``rate_expression``."""
    return fit(table, weights, budget, steps)[:2]


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, posterior (in the order of ``targets``), rate, copies."""
    domains, weights = list(targets), list(targets.values())
    table = written(posteriors(docs, labelled, domains, weights), "posteriors")
    start, moves = fitted_rates(table, weights, budget)
    rate, factor = rate_expression(start, moves), 1.0
    if budget is None:
        least = table.agg(F.min(rate)).first()[0]
        if least is not None and FAINT < least < 1:
            factor = (1 + 1e-12) / least
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    return table.withColumn("rate", rate * factor).withColumn(
        "copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their tokens, rate and number of copies."""
    decided = mixed(docs, labelled, targets, budget).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("tokens").alias("_tokens"), F.avg("rate").alias("_rate"), F.max("copies").alias("_copies")).where("_copies > 0")
    kept = docs.join(decided, docs["doc_id"].cast("long").eqNullSafe(decided["_id"]))
    named = ("tokens", "rate", "copies")
    return kept.select(*[docs[quoted(c)] for c in docs.columns if c not in named], *[decided[f"_{n}"].alias(n) for n in named])
