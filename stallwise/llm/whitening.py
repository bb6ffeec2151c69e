"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi on its factor.

A vector's entries c become whole numbers x = floor(``STEPS`` * c). The fit list holds each distinct x vector once;
its covariance V (divisor n, centred before multiplying) is factored as P V P' = L L' by Cholesky with diagonal
pivots. One-sided Jacobi then rotates the columns of L until they are orthogonal: their squared norms are the
eigenvalues of V, and the columns brought to unit length, in the order of V's rows again, its eigenvectors. No product
of L is formed, so small eigenvalues keep their digits. Columns that the pivots show to be zero are left out.

How the work is spread: distinct vectors are found by a grouped exchange that combines copies first, so a
vector that a third of all rows hold travels once per task, and are stored. Each task adds up the sums, and then the
centred scatter, of its share in one matrix; entries of the matrices are added up by a second exchange.
Only sums (one per dimension), the scatter (dimensions squared) and the components reach the driver, whatever
the number of rows. All rows are projected where they are.

Defined results: rows whose vector is NULL, or holds a NULL or an entry that is not finite, are dropped; a
shorter vector counts as having zeros at its end, up to the longest; ids may be NULL or repeat, and every row stays;
with fewer dimensions or a lower rank than ``components`` there are fewer components (none for
equal vectors, an empty table or empty vectors, which give an empty result). A component's largest entry
is positive. ``deviation`` is exact, and NULL where it passes a 64-bit integer. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.tables import materialise, read, whole_row

STEPS = 256  # fixed value: whole numbers to a unit
COMPONENTS = 4
BLOCK_VALUES = 1 << 20  # numbers that a task multiplies or projects at a time
_LARGEST = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """``axes[k]`` is the k-th unit component, ``variances[k]`` its eigenvalue."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    @property
    def scales(self) -> np.ndarray:
        return self.axes.T / np.sqrt(self.variances)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with a[order][:, order] = L L', L lower trapezoidal; the largest rest on the diagonal goes first,
    and it ends where nothing but rounding is left."""
    a = a.copy()
    size = len(a)
    order = np.arange(size)
    factor = np.zeros((size, size))
    floor = size * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= floor:
            return order, factor[:, :k]
        for m in (a, factor, order):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        factor[k, k] = np.sqrt(a[k, k])
        rest = factor[k + 1 :, k]
        a[k + 1 :, k + 1 :] -= np.outer(rest, rest)
    return order, factor


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times the rotations that make its columns orthogonal, a round of disjoint pairs at a time."""
    g = factor.copy()
    count = g.shape[1]
    ring = list(range(count)) + [-1] * (count % 2)
    half = len(ring) // 2
    rounds = []
    for _ in range(max(len(ring) - 1, 0)):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if min(a, b) >= 0]
        rounds.append(np.array(pairs, np.int64).reshape(-1, 2).T)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        moved = False
        for i, j in rounds:
            x, y = g[:, i], g[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            moved = True
            safe = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = np.where(turn, c * t, 0.0)
            c = np.where(turn, c, 1.0)
            g[:, i], g[:, j] = c * x - s * y, s * x + c * y
        if not moved:
            break
    return g


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of the part of a covariance that is not zero."""
    order, factor = pivoted_cholesky(covariance)
    rotated = jacobi_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    ranked = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(ranked), len(order)))
    vectors[:, order] = (rotated[:, ranked] / norms[ranked]).T
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)] if len(vectors) else np.zeros(0)
    return norms[ranked] ** 2, vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


def _finite(vector: Column) -> Column:
    """The vector has no NULL and no entry that is not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _whole_numbers(vector: Column, size: int) -> Column:
    """floor(256 c) of each entry, zeros behind the last."""
    whole = F.transform(vector, lambda c: F.floor(c * F.lit(float(STEPS))).cast("bigint"))
    return F.slice(F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), size)), 1, size)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(BLOCK_VALUES // max(size, 1), 1)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, _matrix(part.column(column), size)


def _entries(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int64()), "value": pa.array(total.ravel())})


def _sum_partition(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sum of each dimension, and the number of vectors behind them."""
    total = np.zeros(size + 1, np.int64)
    for _, x in _blocks(batches, size):
        total += np.append(x.sum(0), len(x))
    if total[-1]:
        yield _entries(total)


def _scatter_partition(batches: Iterator[pa.RecordBatch], size: int, mean: np.ndarray, scales: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Products of the centred vectors, or of their projections; with these, their sums behind them."""
    wide = size if scales is None else scales.shape[1]
    total, sums = np.zeros((wide, wide)), np.zeros(wide)
    for _, x in _blocks(batches, size):
        y = x - mean
        if scales is not None:
            y = y @ scales
            sums += y.sum(0)
        total += y.T @ y
    yield _entries(total.ravel() if scales is None else np.append(total.ravel(), sums))


def _added(rows: DataFrame, entries: int, kind: type) -> np.ndarray:
    """Entries added up over all tasks, in place."""
    table = rows.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(entries, kind)
    out[table["at"].to_numpy()] = table["value"].to_numpy()
    return out


def fit_list(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """A stored table of the distinct whole-number vectors ``x``, and their length."""
    sound = df.select(F.col(vector).alias("vector")).filter(_finite(F.col("vector")))
    size = sound.agg(F.max(F.size("vector"))).first()[0] or 0
    return materialise(sound.select(_whole_numbers(F.col("vector"), size).alias("x")).distinct()), size


def fit_whitening(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Mean and leading components of a fit list."""
    if not size:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    counted = _added(fit.mapInArrow(partial(_sum_partition, size=size), "at bigint, value bigint"), size + 1, np.int64)
    n, sums = int(counted[-1]), counted[:-1]
    if not n:
        return Whitening(0, sums, np.zeros((0, size)), np.zeros(0), 0.0, 0.0)
    mean = sums / n
    add = partial(_scatter_partition, size=size, mean=mean)
    covariance = _added(fit.mapInArrow(partial(add, scales=None), "at bigint, value double"), size * size, float).reshape(size, size) / n
    values, vectors = eigen((covariance + covariance.T) / 2)
    values, vectors = values[:components], vectors[:components]
    wide, scales = len(values), vectors.T / np.sqrt(values)
    error = 0.0
    if wide:
        seen = _added(fit.mapInArrow(partial(add, scales=scales), "at bigint, value double"), wide * wide + wide, float) / n
        products, means = seen[: wide * wide].reshape(wide, wide), seen[wide * wide :]
        error = float(np.abs(products - np.outer(means, means) - np.eye(wide)).max())
    return Whitening(n, sums, vectors, values, float(covariance.trace()), error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact."""
    bound = n * max(int(np.abs(x.astype(float)).max(initial=0.0)), 1) + int(np.abs(sums.astype(float)).max(initial=0.0)) + 1
    if bound * bound * x.shape[1] < _LARGEST:
        y = n * x - sums
        return (y * y).sum(1).tolist()
    parts = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [value if value < _LARGEST else None for value in parts]


def _project_partition(batches: Iterator[pa.RecordBatch], size: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    wide = len(model.variances)
    mean, scales, share = model.sums / max(model.n, 1), model.scales, model.variances / model.trace if wide else model.variances
    for part, x in _blocks(batches, size):
        made = {
            "component": np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x)),
            "n": np.full(len(x) * wide, model.n, np.int64),
            "whitened": ((x - mean) @ scales).ravel(),
            "explained": np.tile(share, len(x)),
            "identity_error": np.full(len(x) * wide, model.identity_error),
        }
        at = pa.array(np.repeat(np.arange(len(x)), wide))
        deviation = pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(at)
        columns = {name: pa.array(values) for name, values in made.items()} | {"row": part.column("row").take(at), "deviation": deviation}
        yield pa.RecordBatch.from_pydict({name: columns[name] for name in ("row", "component", "n", "deviation", "whitened", "explained", "identity_error")})


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``row`` (all columns but the vector) with one row for each component: ``component, n, deviation, whitened,
    explained, identity_error``. The model is fitted while this DataFrame is built."""
    fit, size = fit_list(df, vector)
    model = fit_whitening(fit, size, components)
    rest = df.drop(vector) if len(df.columns) > 1 else df.select(F.lit(None).cast("int").alias("none"))
    rows = df.filter(_finite(F.col(vector))).select(whole_row(rest), _whole_numbers(F.col(vector), size).alias("x"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not len(model.variances):
        rows = rows.limit(0)
    return rows.mapInArrow(partial(_project_partition, size=size, model=model), schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    found = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("row.vec_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
