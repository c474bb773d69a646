"""Whitening of embeddings by Jacobi-Davidson: leading eigenvectors of their covariance from products with blocks of vectors only.

Entries become whole numbers, floor(64 c) + 1000000, so that sums and squared deviations are exact. They are written once as packed
chunks; after that each product of the covariance with a block of columns is a pass over the chunks, in which every row is centred
before it is multiplied, and only sums of the block's size leave a task. The covariance itself is never formed.

The driver holds vectors of the embedding's dimension alone. It works on a subspace: the Rayleigh-Ritz step gives approximate pairs and their
residuals; for those that haven't converged the correction equations, projected away from all Ritz and locked vectors, are solved by a few steps
of MINRES, all columns in the same passes; the corrections enlarge the subspace, which is cut back to its leading Ritz vectors when it
is full. Pairs whose residual has reached double precision (`tolerance` of the largest eigenvalue) are locked in falling order, until all
have. Where rounding stops the residuals a little above that, they are taken if they are below `floor`.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped; where lengths differ those of the most
frequent length count (the shortest of several); numbers beyond 2^31 are cut to it (entries beyond 33 million) and deviations beyond a long
to its greatest value; directions without variance have no component, so equal vectors or a single one give no rows; a null
vec_id is kept as it is; repeated rows count and are given each; an empty table gives an empty result. Only vec_id and the vector are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.frames import for_workers, stored

SHIFT, SCALE, MOST = 1_000_000, 64.0, (1 << 31) - 1
COMPONENTS, SPARE = 32, 8
TOLERANCE, FLOOR = 2e-14, 1e-11
#: Rows and bytes of a packed chunk, and partial sums that come to the driver without being added up first.
CHUNK, CHUNK_BYTES, PARTS = 4_096, 4 << 20, 256
LONGEST = np.iinfo(np.int64).max


# -- eigenvectors

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(new: np.ndarray, *against: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of what `new` adds to orthonormal columns."""
    scale = np.linalg.norm(new, axis=0)
    new = new[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > least]
    return new


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, away: np.ndarray, steps: int, close: float) -> np.ndarray:
    """Approximate solutions t, orthogonal to `away`, of (A - shift) t = right projected away from it, a shift a column."""
    project = lambda y: y - away @ (away.T @ y)
    right = project(right)
    first = np.linalg.norm(right, axis=0)
    nonzero = lambda x: np.where(x > 0, x, 1.0)
    t, v, v_old = np.zeros_like(right), right / nonzero(first), np.zeros_like(right)
    w, w_old = np.zeros_like(right), np.zeros_like(right)
    eta, beta = first.copy(), first.copy()
    c = c_old = np.ones_like(first)
    s = s_old = np.zeros_like(first)
    live = first > 0
    for _ in range(steps):
        q = project(product(v) - shifts * v)
        alpha = (v * q).sum(0)
        q = q - alpha * v - beta * v_old
        beta_new = np.linalg.norm(q, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        live = live & (rho > 0)
        c_new, s_new = delta / nonzero(rho), beta_new / nonzero(rho)
        w_new = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / nonzero(rho)
        t = t + np.where(live, c_new * eta, 0) * w_new
        eta = np.where(live, -s_new * eta, 0)
        v, v_old, w, w_old = q / nonzero(beta_new), v, w_new, w
        beta, c, c_old, s, s_old = beta_new, c_new, c, s_new, s
        live = live & (beta_new > 1e-14 * nonzero(first))
        if (np.abs(eta) <= close * first).all():
            break
    return t


class Pairs(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = basis.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], basis @ turn, image @ turn


def jacobi_davidson(product: Product, dim: int, most: int, seed: int = 7, steps: int = 8, rounds: int = 60, tolerance: float = TOLERANCE, floor: float = FLOOR) -> Pairs:
    """The `most` leading eigenpairs of a symmetric product, in falling order."""
    most = min(most, dim)
    room = min(dim, most + SPARE)
    locked = np.zeros((dim, 0))
    basis = orthonormal(np.random.default_rng(seed).standard_normal((dim, room)))
    image = product(basis)
    top, stuck, worst_before = 0.0, 0, np.inf
    for _ in range(rounds):
        values, vectors, images = _ritz(basis, image)
        need = most - locked.shape[1]
        top = max(top, float(np.abs(values).max(initial=0)))
        rest = images[:, :need] - vectors[:, :need] * values[:need]
        size = np.linalg.norm(rest, axis=0)
        good = size <= tolerance * top
        worst = size.max(initial=0)
        stuck = stuck + 1 if worst > 0.5 * worst_before else 0
        worst_before = min(worst, worst_before)
        if stuck >= 3 and worst <= floor * top:
            good[:] = True
        done = len(good) if good.all() else int(good.argmin())
        locked = np.concatenate([locked, vectors[:, :done]], 1)
        basis, image = vectors[:, done:], images[:, done:]
        if locked.shape[1] == most:
            break
        values, need = values[done:], most - locked.shape[1]
        if basis.shape[1] + need > max(3 * most, room) or basis.shape[1] + locked.shape[1] >= dim:
            basis, image = basis[:, : need + SPARE], image[:, : need + SPARE]
        open_ = np.flatnonzero(~good[done:])
        away = np.concatenate([locked, basis[:, :need]], 1)
        more = minres(product, values[:need][open_], -(image[:, :need] - basis[:, :need] * values[:need])[:, open_], away, steps, 1e-2)
        more = orthonormal(more, locked, basis)
        if more.shape[1] == 0:
            more = orthonormal(np.random.default_rng(seed + 1).standard_normal((dim, 1)), locked, basis)
        if more.shape[1]:
            basis, image = np.concatenate([basis, more], 1), np.concatenate([image, product(more)], 1)
        # locked vectors are exact to rounding only: keep their share out of the images' part of the subspace
        image = image - locked @ (locked.T @ image)
    if locked.shape[1] < most:
        raise ArithmeticError(f"{most - locked.shape[1]} eigenpairs didn't converge; the worst residual is {worst:.1e} of {top:.1e}")
    values, vectors, images = _ritz(orthonormal(locked), product(orthonormal(locked)))
    return Pairs(values, vectors, np.linalg.norm(images - vectors * values, axis=0))


# -- on Spark


class Fit(NamedTuple):
    """The packed rows of a fit list, its size, exact sums and trace of the covariance, and what deletes the rows."""

    chunks: DataFrame
    parts: int
    dim: int
    n: int
    sums: np.ndarray
    trace: float
    drop: Callable[[], None]


CHUNKS = "ids array<long>, x binary"


def _summed(fit_parts: int, partial: DataFrame) -> np.ndarray:
    """The sum of float arrays in a column of bytes, first in a few tasks where there are many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                values = np.frombuffer(part.as_py())
                total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    few = partial if fit_parts <= PARTS else partial.repartition(PARTS // 8).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r.part) for r in few.collect()], axis=0)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64) + SHIFT


def fit_rows(vectors: DataFrame, key: str, column: str) -> Fit | None:
    """The rows that take part, packed, with their sums; None where there are none."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size(column) > 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return None
    dim, most = lengths["dim"], max(1, min(CHUNK, CHUNK_BYTES // (8 * lengths["dim"])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            for i in range(0, len(batch), most):
                ids = batch.column(0).slice(i, most)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x[i : i + most].tobytes()], pa.binary())], names=["ids", "x"])

    chunks, drop = stored(for_workers(rows.where(F.size("v") == dim)).mapInArrow(pack, CHUNKS))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, [0] * dim, 0
        for x in _chunks_of(batches, dim):
            n += len(x)
            first = [a + b for a, b in zip(first, x.sum(0).tolist(), strict=True)]
            second += sum(int(h) * int(h) for h in x.ravel().tolist()) if np.abs(x).max(initial=0) > 1 << 24 else int((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([n, second, first])])], names=["sums"])

    n, second, first = 0, 0, [0] * dim
    for row in chunks.select("x").mapInArrow(sums, "sums string").toLocalIterator():
        m, q, s = json.loads(row.sums)
        n, second, first = n + m, second + q, [a + b for a, b in zip(first, s, strict=True)]
    trace = (n * second - sum(s * s for s in first)) / n**2
    return Fit(chunks, chunks.rdd.getNumPartitions(), dim, n, np.array(first, np.int64), trace, drop)


def _chunks_of(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column(column):
            yield np.frombuffer(value.as_buffer(), np.int64).reshape(-1, dim)


def covariance_product(fit: Fit) -> Product:
    """What multiplies a block of columns with the covariance (divisor n), in one pass over the chunks."""
    dim, n, sums = fit.dim, fit.n, fit.sums

    def product(columns: np.ndarray) -> np.ndarray:
        shared = fit.chunks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y, total = shared.value, 0
            for x in _chunks_of(batches, dim):
                centred = (n * x - sums) / n
                total = total + centred.T @ (centred @ y)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["part"])

        out = _summed(fit.parts, fit.chunks.select("x").mapInArrow(run, "part binary")).reshape(columns.shape) / n
        shared.destroy()
        return out

    return product


def deviations(apart: np.ndarray) -> np.ndarray:
    """Of each row of n x - S the exact sum of squares."""
    size = (apart.astype(float) ** 2).sum(1)
    near = size > 9e18
    out = np.where(near, 0, (np.where(near[:, None], 0, apart) ** 2).sum(1))
    for i in np.flatnonzero(near).tolist():
        out[i] = min(sum(v * v for v in apart[i].tolist()), int(LONGEST))
    return out


def _identity_error(fit: Fit, turn: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    dim, n, sums, size = fit.dim, fit.n, fit.sums, turn.shape[1]

    def pass_over(mean: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size if mean is None else (size, size))
            for x in _chunks_of(batches, dim):
                white = (n * x - sums) / n @ turn
                total += white.sum(0) if mean is None else (white - mean).T @ (white - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        return _summed(fit.parts, fit.chunks.select("x").mapInArrow(run, "part binary")) / n

    covariance = pass_over(pass_over(None)).reshape(size, size)
    return float(np.abs(covariance - np.eye(size)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    fit = fit_rows(vectors, key, column)
    pairs = None if fit is None else jacobi_davidson(covariance_product(fit), fit.dim, most)
    kept = 0 if pairs is None else int((pairs.values > 1e-12 * max(pairs.values.max(initial=0), fit.trace / fit.dim)).sum())
    if not kept:
        return vectors.sparkSession.createDataFrame([], RESULT)
    values, turn = pairs.values[:kept], pairs.vectors[:, :kept] / np.sqrt(pairs.values[:kept])
    dim, n, sums, explained, error = fit.dim, fit.n, fit.sums, values / fit.trace, _identity_error(fit, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, value in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(value.as_buffer(), np.int64).reshape(-1, dim)
                for i in range(0, len(x), 512):
                    apart = n * x[i : i + 512] - sums
                    m = len(apart)
                    each = lambda values: pa.array(np.repeat(values, kept))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.values.slice(i, m).take(each(np.arange(m))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), each(np.full(m, n)), each(deviations(apart)),
                            pa.array((apart / n @ turn).ravel()), pa.array(np.tile(explained, m)), each(np.full(m, error)),
                        ],
                        names=[f.split()[0] for f in RESULT.split(", ")],
                    )

    return fit.chunks.mapInArrow(run, RESULT)
