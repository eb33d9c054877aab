"""Whitening of embeddings by their leading principal components, found with a block Jacobi-Davidson method that never forms the covariance.

Entries become longs ``floor(1024 * c) + 100000``; sums of them and the centred numerators ``n * x - S`` are exact.

1. *Products.* The only way to the covariance V is V times a few columns: each task multiplies its centred vectors with the columns and back, and the
   partial products are added up by entry in Spark. A product brings (dimensions x columns) numbers to the driver, whatever the number of vectors.
2. *Outer steps.* Rayleigh-Ritz in the search space gives Ritz pairs. Leading pairs whose residual is below ``TOLERANCE`` times the largest Ritz value are
   locked: later work is orthogonal to them. For the others the correction equation, projected against the locked and the current Ritz vectors, is solved by
   a few MINRES steps, all columns in step, so that one inner step is one product; the solutions widen the search space, which is cut back to the leading
   Ritz vectors where it grows beyond ``SPACE`` columns for each wanted one.
3. *Result.* A last Rayleigh-Ritz step on the locked vectors, and one pass for the covariance of the whitened rows against the identity.

Vectors are kept in blocks of one row per Arrow batch (about ``BLOCK_BYTES``), written once; no step shuffles vectors.

Cases: a vector that is null, has null or non-finite entries, or entries of 2**40 and more in size (not exact as longs) is left out, and an empty one; so are vectors of other than the most frequent
number of dimensions (of equally frequent ones the larger). Fewer than eight dimensions give as many components. A component without variance (one vector, equal vectors) has null
``whitened``; without any variance ``explained`` and ``identity_error`` are null. Equal eigenvalues give any orthonormal pair of their plane. Repeated rows and null or equal ids are rows of their
own; a ``deviation`` beyond a long is null; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Residuals of unit vectors that count as double precision, against the largest Ritz value and for 64 dimensions (it grows with their root).
TOLERANCE = 32 * 2.0 ** -52
SPACE = 10
INNER = 4
INNER_GAIN = 0.05
OUTER = 100
LARGEST = float(1 << 40)
BLOCK_BYTES = 4 << 20
SEED = 13
_log = logging.getLogger(__name__)


def scaled_blocks(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Blocks of scaled vectors: d, n, ids, x (n times d longs), total (their sums), largest (entry in size)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = lists.is_valid().to_numpy(zero_copy_only=False)
            good[owner[~(np.abs(flat) < LARGEST)]] = False
            heads = np.cumsum(sizes) - sizes
            for d in np.setdiff1d(sizes[good], [0]):
                rows = np.flatnonzero(good & (sizes == d))
                step = max(1, min(4096, BLOCK_BYTES // (8 * int(d))))
                for at in range(0, len(rows), step):
                    mine = rows[at:at + step]
                    x = np.floor(flat[heads[mine][:, None] + np.arange(d)] * SCALE).astype(np.int64) + SHIFT
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([batch.column(0).take(pa.array(mine)).to_pylist()], pa.list_(pa.int64())),
                         pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0)], pa.list_(pa.int64())), pa.array([int(np.abs(x).max(initial=0))], pa.int64())],
                        names=["d", "n", "ids", "x", "total", "largest"])

    narrow = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "d int, n long, ids array<long>, x binary, total array<long>, largest long")


class Centred:
    """The blocks of vectors of one size with their exact sums: the distributed operator V."""

    def __init__(self, blocks: DataFrame):
        kinds = blocks.groupBy("d").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy(F.desc("n"), F.desc("d")).first()
        self.d, self.n = (kinds.d, int(kinds.n)) if kinds else (0, 0)
        self.blocks = blocks.where(F.col("d") == self.d)
        sums = self.blocks.select(F.posexplode("total").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [0] * self.d
        for row in sums:
            self.sums[row.k] = int(row.s)
        bound = (kinds.largest if kinds else 0) * self.n + max(map(abs, self.sums), default=0)
        self.exact = np.int64 if bound < 1 << 62 else object  # longs where they suffice, else Python's integers
        self.products = 0

    def rows_of(self) -> Callable[[bytes], np.ndarray]:
        """The function from a block's bytes to ``n * x - S``."""
        d, n, kind = self.d, self.n, self.exact
        sums = np.array(self.sums, kind)
        return lambda raw: np.frombuffer(raw, np.int64).reshape(-1, d).astype(kind) * n - sums

    def added(self, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of a function of their centred vectors (doubles)."""
        rows_of, n, size = self.rows_of(), self.n, int(np.prod(shape))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0):
                    part = of_block(rows_of(raw.as_py()).astype(np.float64) / n)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.ravel(total))], names=["k", "s"])

        out = np.zeros(size)
        for row in self.blocks.select("x").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            out[row.k] = row.s
        return out.reshape(shape)

    def times(self, columns: np.ndarray) -> np.ndarray:
        """V times ``columns``."""
        self.products += 1
        return self.added(lambda y: y.T @ (y @ columns), columns.shape) / self.n

    def trace(self) -> float:
        return float(self.added(lambda y: np.array([np.einsum("ij,ij->", y, y)]), (1,))[0]) / self.n


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` add to the orthonormal columns ``against``."""
    basis = against
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size and basis.shape[1] < len(column):
            column = column / left
            basis = np.column_stack([basis, column - basis @ (basis.T @ column)])
    return basis[:, against.shape[1]:]


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """About the solutions of symmetric systems, one for each column of ``right``; ``times`` takes all columns at once.

    Lanczos vectors come from a three-term recurrence, their tridiagonal matrix is triangularised by one rotation a step. It ends after ``steps`` or when
    every residual fell to ``gain`` of its start.
    """
    size = np.linalg.norm(right, axis=0)
    v = right / np.where(size > 0, size, 1)
    v_old, beta = np.zeros_like(v), np.zeros(len(size))
    w_old, w = np.zeros_like(v), np.zeros_like(v)
    solution, rest = np.zeros_like(v), size.copy()
    c_old, s_old, c, s = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    for _ in range(steps):
        product = times(v)
        alpha = np.einsum("ij,ij->j", v, product)
        v_new = product - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        # the new column of the tridiagonal matrix under the last two rotations, then the rotation that clears its last entry
        far, middle = s_old * beta, c_old * beta
        near, diagonal = c * middle + s * alpha, c * alpha - s * middle
        length = np.hypot(diagonal, beta_new)
        safe = np.where(length > 0, length, 1)
        c_old, s_old, c, s = c, s, diagonal / safe, beta_new / safe
        w_old, w = w, (v - far * w_old - near * w) / safe
        solution = solution + np.where(length > 0, c * rest, 0) * w
        rest = np.where(length > 0, -s * rest, 0)
        v_old, v, beta = v, v_new / np.where(beta_new > 0, beta_new, 1), beta_new
        if (np.abs(rest) <= gain * size).all():
            break
    return solution


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``count`` largest eigenvalues of a symmetric operator, falling; ``times`` is all that is known of it."""
    count = min(count, d)
    locked, values, tolerance = np.zeros((d, 0)), np.zeros(0), TOLERANCE * max(1.0, d / 64) ** 0.5
    space = _orthonormal(np.random.default_rng(SEED).standard_normal((d, min(d, 2 * count))), locked)
    image, scale = times(space) if count else space, 0.0
    for step in range(OUTER):
        if locked.shape[1] >= count:
            break
        inside = space.T @ image
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        wanted = count - locked.shape[1]
        rest = image[:, :wanted] - space[:, :wanted] * theta[:wanted]
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        full = space.shape[1] + locked.shape[1] == d  # nothing is left to search: only rounding remains
        done = len(size) if full else int(np.argmin(np.r_[size <= tolerance * scale, False]))
        if step == OUTER - 1 and done < wanted:
            _log.warning("residuals of %s remain, of a largest eigenvalue of %.6g", size[done:], scale)
            done = wanted
        locked, values = np.column_stack([locked, space[:, :done]]), np.r_[values, theta[:done]]
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        open_ = count - locked.shape[1]
        if not open_:
            break
        if space.shape[1] > SPACE * count:
            space, image, theta = space[:, :2 * count], image[:, :2 * count], theta[:2 * count]
        near = min(2 * count, space.shape[1])  # Ritz vectors behind the wanted ones are worked on, too: columns cost little, products much
        out = np.column_stack([locked, space[:, :near]])
        project = lambda z, out=out: z - out @ (out.T @ z)
        shifts = theta[:near]
        rest = image[:, :near] - space[:, :near] * shifts
        wider = minres(lambda z: project(times(project(z))) - shifts * project(z), project(-rest), INNER, INNER_GAIN)
        wider = _orthonormal(np.column_stack([project(wider), rest]), np.column_stack([locked, space]))
        if not wider.shape[1]:
            wider = _orthonormal(np.random.default_rng(SEED + step).standard_normal((d, open_)), np.column_stack([locked, space]))
        more = times(np.column_stack([space[:, :open_], wider]))  # those of the current vectors anew, so that rounding does not add up
        space, image = np.column_stack([space, wider]), np.column_stack([more[:, :open_], image[:, open_:], more[:, open_:]])
        image = image - locked @ (locked.T @ image)
    if not count:
        return values, locked
    inside = locked.T @ times(locked)
    theta, turn = np.linalg.eigh((inside + inside.T) / 2)
    vectors = locked @ turn[:, ::-1]
    strongest = vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]
    return np.maximum(theta[::-1], 0.0), vectors * np.where(strongest < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    v = Centred(written(scaled_blocks(vectors, vec_id, embedding), "vectors"))
    trace = v.trace() if v.n else 0.0
    values, axes = leading_pairs(v.times, v.d if v.n else 0, components)
    spread = values > 1e-13 * max(trace, 0.0)
    scaled = axes / np.sqrt(np.where(spread, values, 1.0))
    error = None
    if spread.any():
        used = scaled[:, spread]
        moments = v.added(lambda y: (lambda z: np.vstack([z.T @ z, z.sum(axis=0)]))(y @ used), (used.shape[1] + 1, used.shape[1])) / v.n
        error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(used.shape[1])).max())
    explained = [float(e) / trace if trace > 0 else None for e in values]
    rows_of, n, count = v.rows_of(), v.n, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1)):
                exact = rows_of(raw.as_py())
                z = (exact.astype(np.float64) / n) @ scaled
                held = pa.array(np.ravel(z), mask=np.tile(~spread, len(z)))
                if exact.dtype == object or float(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] >= 2.0 ** 62:
                    squares = [s if s < 1 << 63 else None for s in (exact.astype(object) ** 2).sum(axis=1)]
                else:
                    squares = (exact * exact).sum(axis=1)
                own = pa.array(np.repeat(np.arange(len(z)), count))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(own), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))), pa.array(np.full(len(own), n)),
                     pa.array(squares, pa.int64()).take(own), held, pa.array(explained * len(z), pa.float64()), pa.array([error] * len(own), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return v.blocks.select("ids", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
