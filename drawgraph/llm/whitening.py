"""Whitening of embeddings: distributed centred covariance, its leading eigenvectors, a broadcast projection.

The covariance of d components is a d x d table that tasks sum up in parts. Its leading eigenvalues come from a
Householder tridiagonal form and bisection by Sturm counts, its components from inverse iteration, with those of close
eigenvalues made orthogonal to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawgraph.llm.common import cut

#: A component x counts as floor(SCALE x) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Numbers are below this in size, so that a task's sums stay exact.
LIMIT = 1 << 40
#: Most components of a vector: the covariance is one table of the driver's.
MOST_DIMENSIONS = 4096
#: An eigenvalue below this share of the trace is no direction in which the vectors differ.
LEAST_SHARE = 1e-10
#: Eigenvalues nearer than this share of the norm get orthogonal vectors by force.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and orthogonal Q of T = Q' A Q for a symmetric A, by Householder reflections."""
    a = np.array(matrix, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        x[0] += size if x[0] >= 0 else -size
        u = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2.0 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2.0 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number: signs of a Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    least = max(tiny, float((side * side).max(initial=0.0)) * np.finfo(float).eps ** 2)
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for d, e in zip(diagonal, np.insert(side * side, 0, 0.0), strict=True):
        pivot = d - at - e / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    n = len(diagonal)
    reach = np.abs(np.append(side, 0.0)) + np.abs(np.insert(side, 0, 0.0))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * n
    low, high = low - margin, high + margin
    rank = n - np.arange(1, k + 1)  # so many eigenvalues lie below the one that is sought
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        under = below(diagonal, side, middle) > rank
        low, high = np.where(under, low, middle), np.where(under, middle, high)


def _solved(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchange; pivots that vanish count as rounding errors."""
    n = len(diagonal)
    least = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(side).max(initial=0.0) or 1.0)
    a, b, c, x = (diagonal - shift).tolist(), [*side.tolist(), 0.0], [0.0] * n, right.tolist()  # U's three diagonals
    for i in range(n - 1):
        e, d, f = float(side[i]), a[i + 1], b[i + 1]
        if abs(e) > abs(a[i]):  # the next row has the larger pivot
            m = a[i] / e
            a[i], a[i + 1] = e, b[i] - m * d
            b[i], b[i + 1], c[i] = d, -m * f, f
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
        else:
            a[i] = a[i] if abs(a[i]) > least else least
            m = e / a[i]
            a[i + 1] = d - m * b[i]
            x[i + 1] -= m * x[i]
    a[-1] = a[-1] if abs(a[-1]) > least else least
    for i in range(n - 1, -1, -1):
        x[i] -= (b[i] * x[i + 1] if i + 1 < n else 0.0) + (c[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= a[i]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (as columns) of falling eigenvalues, by inverse iteration."""
    n = len(diagonal)
    size = float(np.abs(diagonal).max() + 2 * np.abs(side).max(initial=0.0)) or 1.0
    rng = np.random.default_rng(n)  # fixed start vectors: the result depends on the matrix only
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        shift = min(value, shift - 4 * np.finfo(float).eps * size) if j > first else value  # never the same one twice
        x = rng.standard_normal(n)
        for _ in range(5):
            near = out[:, first:j]
            x -= near @ (near.T @ x)
            x = _solved(diagonal, side, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
        near = out[:, first:j]
        for _ in range(2):
            x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    diagonal, side, q = tridiagonal(matrix)
    values = leading_values(diagonal, side, min(k, len(diagonal)))
    return values, q @ vectors_of(diagonal, side, values)


def _numbers(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(fit: DataFrame, d: int, k: int, turned: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of all rows of ``fit``, each turned into ``k`` numbers: k x k numbers at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = turned(_numbers(batch.column(0), d))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((k, k))
    for r in parts.filter("i <= j").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum of (n x - rest) ** 2 of each row, exact; null if a long can't hold it."""
    reach = (int(np.abs(x).max(initial=0)) + 1) * n
    if reach * reach * x.shape[1] < 1 << 63:
        return ((x * n - rest) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)  # whole numbers of any size
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one for each vector and component.

    A vector takes part unless it is null or holds a null, NaN or infinite entry. Entry c counts as the whole number
    x = floor(64 c) + 1000000. Each different x vector is fitted once: ``n`` of them, with sums S of each dimension.
    Components are the unit eigenvectors of their covariance V (divisor n, centred before multiplying) by falling
    eigenvalue e, numbered from 1. ``deviation`` is the sum of (n x - S) ** 2 over the dimensions, exact; ``whitened``
    the projection of x - S / n over sqrt(e); ``explained`` e over the trace of V; ``identity_error`` the largest entry,
    in size, of the covariance of the fitted vectors' whitened values minus the identity.

    Sums and covariances are d and d x d numbers whatever the input; only they pass through the driver. Copies of one
    vector are counted together before the shuffle.

    A direction in which the fitted vectors don't differ is no component, so fewer than ``components`` (none for one
    different vector) may come out. Vectors with another number of entries than most different vectors have (ties: the
    greater), and those with a number of 2 ** 40 or more, take no part. A deviation beyond a long is null. Null ids and
    repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    whole = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LIMIT, F.lit(False)))  # not for NaN either
    rows = (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        .filter("v is not null")
        .filter(whole)
        .select("id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)).alias("x"))
    )
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = cut(rows.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or sizes["d"] == 0:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {schema}")
    d, n = sizes["d"], sizes["count"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} components: their covariance is more than the driver takes")
    fit, rows = fit.filter(F.size("x") == d), rows.filter(F.size("x") == d)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _numbers(batch.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    sums = [0] * d
    for r in fit.mapInArrow(added, "i int, v bigint").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[r["i"]] = int(r["v"])
    base = np.array([s // n for s in sums], np.int64)  # whole part of the mean
    rest = np.array([s % n for s in sums], np.int64)  # and what remains of the sum
    mean = rest / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - mean  # small numbers: nothing is lost

    covariance = _moments(fit, d, d, centred) / n
    trace = float(np.trace(covariance))
    if trace <= 0:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {schema}")
    values, directions = leading(covariance, min(components, d))
    some = values > LEAST_SHARE * trace
    values, projection = values[some], directions[:, some] / np.sqrt(values[some])
    k = len(values)
    error = float(np.abs(_moments(fit, d, k, lambda x: centred(x) @ projection) / n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column(1), d)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviations(x - base, n, rest), pa.int64()).take(at),
                    pa.array((centred(x) @ projection).reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
