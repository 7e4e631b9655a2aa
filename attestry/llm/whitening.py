"""Embedding whitening: block Lanczos on the covariance, which is never built; each step is one pass over all vectors.

The driver holds the basis (dimensions by steps) and asks for V Q, where V is the covariance of the centred vectors: tasks
multiply their rows with the block Q and add up, Spark adds the tasks' sums. Every new block is orthogonalised against the
whole basis, twice. A block that breaks down (nothing new in some direction) is filled up with random directions
orthogonal to the basis, so that equal eigenvalues are found too. It ends when the residuals of all wanted pairs are small
against the largest eigenvalue and stay so after a restart from random directions, or when the basis spans the space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import keep, within_bounds

#: Components that are wanted at most, columns of a block, and residual at which a pair has converged, against the largest eigenvalue.
COMPONENTS, WIDTH, RESIDUAL = 32, 8, 1e-14
#: Further steps from a random block, after the pairs have converged: an eigenvalue of more copies than a block is wide shows there.
CHECKS = 3
#: Eigenvalues below this share of the largest one are zero but for rounding.
ZERO = 1e-12
SCALE, SHIFT = 64, 1_000_000
#: Rows of a matrix product at once.
ROWS = 4096
_TOP = 1 << 62


def lanczos(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, width: int = WIDTH, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), falling, of a symmetric positive semidefinite operator given by its product
    with a block. At most `wanted` pairs."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    block = rng.standard_normal((dims, min(width, dims)))
    steady, more = None, 0
    while True:
        new = _orthonormal(block, basis, min(width, dims - basis.shape[1]), rng)
        of = product(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, of])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:wanted]
        values, vectors = values[order], vectors[:, order]
        rest = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        found = len(order) == wanted and (rest <= residual * max(values[0], 0)).all()
        if found and steady is not None and np.abs(values - steady).max() <= 1e-12 * max(values[0], 0):
            more -= 1
        elif found:
            steady, more = values, CHECKS
        else:
            steady = None
        if basis.shape[1] == dims or found and not more:
            return values, np.linalg.qr(basis @ vectors)[0]
        block = rng.standard_normal(block.shape) if found and more == CHECKS else of


def _orthonormal(block: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """`width` orthonormal columns, orthogonal to the basis, that span the block; random ones where it has nothing new."""
    out = np.zeros((block.shape[0], 0))
    size = np.linalg.norm(block, axis=0)
    columns = list(block[:, np.argsort(-size)].T)
    largest = size.max(initial=0.0)
    while out.shape[1] < width:
        fresh = not columns
        v = rng.standard_normal(block.shape[0]) if fresh else columns.pop(0)
        against = np.hstack([basis, out])
        before = np.linalg.norm(v)
        for _ in range(2):  # twice is enough
            v = v - against @ (against.T @ v)
        after = np.linalg.norm(v)
        if after > (1e-10 * before if fresh else 1e-10 * largest) and after > 0:
            v = v / after
            v = v - against @ (against.T @ v)
            out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def _sum_rows(parts: DataFrame) -> DataFrame:
    """parts (i, v array<double>) added up by i and place."""
    return parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    found = _sum_rows(parts).toArrow()
    out = np.zeros(shape)
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["x"].to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            part = whole.slice(a, ROWS)
            yield part, _matrix(part.column("x"), dims)


def _rows_of(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    mean = np.array([s / n for s in total])
    near = ((x - mean) ** 2).sum(axis=1) * float(n) ** 2
    # int64 is exact where neither n x nor a square can pass 2**62
    safe = (near < 2.0**61) & (np.abs(x).max(axis=1, initial=0) < 2.0**61 / n)
    out: list[int] = [0] * len(x)
    if safe.any() and max(map(abs, total)) < _TOP:
        y = n * x[safe] - np.array(total, np.int64)
        for i, d in zip(np.flatnonzero(safe).tolist(), (y * y).sum(axis=1).tolist(), strict=True):
            out[i] = d
    else:
        safe[:] = False
    for i in np.flatnonzero(~safe).tolist():
        out[i] = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), total, strict=True))
    return out


@within_bounds
def whitened(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS, width: int = WIDTH,
) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Each entry c becomes x = floor(64 c) + 1000000 (64 c is held within 2^62 on either side). Components are unit
    eigenvectors of the covariance of x (divisor n), by falling eigenvalue e; whitened is the centred vector's
    projection over sqrt(e); explained is e over the trace, which is the sum of the deviations over n^3; identity_error
    is the largest entry of the whitened vectors' covariance minus the identity. deviation is null where it passes a long.

    Left out: vectors that are null, or hold null or non-finite entries, or are empty, or have another length than most (the
    longer of equally frequent lengths counts). Components whose eigenvalue is zero are left out, so that a table of one vector,
    or of copies of one, gives no rows, as an empty table does. Rows that repeat an id count each. Other columns are ignored.
    """
    spark = vectors.sparkSession
    entry = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(entry.isNotNull() & (F.size(entry) > 0) & good)
    scaled = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(-float(_TOP)), F.least(F.lit(float(_TOP)), c * SCALE))) + SHIFT)
    rows = keep(rows.select("vec_id", scaled.alias("x")), "scaled")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims, n = length["d"], length["count"]
    rows = rows.where(F.size("x") == dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The exact sum of each dimension, as high and low halves that fit a long."""
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    halves = rows.mapInArrow(sums, "i long, high long, low long").groupBy("i").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    ).collect()
    total = [0] * dims
    for r in halves:
        total[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    whole = [s // n for s in total]
    part = np.array([(s % n) / n for s in total])
    base = np.array(whole, np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken away exactly, then what is left of it."""
        return (x - base) - part

    def product(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for _, x in _blocks(batches, dims):
                c = centred(x)
                out += c.T @ (c @ q)
            yield _rows_of(out)

        return _added(rows.mapInArrow(run, "i long, v array<double>"), q.shape) / n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0
        for _, x in _blocks(batches, dims):
            out += sum(_deviations(x, n, total))
        yield pa.RecordBatch.from_arrays([pa.array([str(out)])], ["d"])

    # a task's sum may have more digits than a decimal holds: it comes in pieces of 18 digits
    digits = rows.mapInArrow(spread, "d string").select(F.explode(F.sequence(F.lit(0), F.floor((F.length("d") - 1) / 18))).alias("p"), "d")
    piece = F.expr("substring(d, greatest(length(d) - 18 * (p + 1), 0) + 1, length(d) - 18 * p - greatest(length(d) - 18 * (p + 1), 0))")
    by = digits.groupBy("p").agg(F.sum(piece.cast("decimal(38,0)")).alias("s")).collect()
    deviation = sum(int(r["s"]) * 10 ** (18 * r["p"]) for r in by)
    trace = float(Decimal(deviation) / Decimal(n) ** 3)
    if not deviation:
        return spark.createDataFrame([], schema)
    values, vectors_ = lanczos(product, dims, wanted, width)
    some = values > ZERO * values[0]
    values, basis = values[some], vectors_[:, some]
    scale = basis / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Second moments of the whitened vectors, and in the last row their sums."""
        k = len(values)
        out = np.zeros((k + 1, k))
        for _, x in _blocks(batches, dims):
            w = centred(x) @ scale
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        yield _rows_of(out)

    k = len(values)
    found = _added(rows.mapInArrow(moments, "i long, v array<double>"), (k + 1, k)) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dims):
            w = centred(x) @ scale
            m = len(x)
            far = [d if d < 1 << 63 else None for d in _deviations(x, n, total)]
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(far, pa.int64()).take(at), pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
