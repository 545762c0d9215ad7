"""Whitening of embeddings by the leading components of their covariance.

Vectors become exact integers ``floor(64 c) + 1000000``. Two distributed passes give their count, sums and centred
covariance: each task multiplies its own block of centred rows and sends one matrix row per dimension; the shuffle adds
them. Only the covariance, as large as the square of the dimension whatever the number of rows, comes to the driver.
There Householder reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, and inverse
iteration their vectors; vectors of close eigenvalues are made orthogonal to each other. The components are broadcast
(dimension x components) and a third pass projects.

Rows whose vector is null, or holds a null, a NaN, an infinity or a number beyond ``LARGEST``, are dropped, as are empty
vectors and those whose length is not the commonest one (of equally common lengths the longest counts). Repeated rows
and null ids count as rows of their own. An empty table gives no rows. Components without variance (eigenvalue lost in
the rounding of the largest) cannot be scaled to unit variance and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtrace.session import settle

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 40  # of a vector's entry; what lies beyond has no exact place in the arithmetic
COMPONENTS = 32
_EPS = np.finfo(float).eps
_LONG = 2 ** 63 - 1


# --- eigenvalues and eigenvectors of a symmetric matrix -------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflections) of the tridiagonal matrix similar to symmetric ``matrix``.

    Row ``k`` of the reflections is the unit vector v of the Householder step I - 2 v v' that clears column ``k``; all
    zeros where there was nothing to clear.
    """
    work, n = np.array(matrix, float), len(matrix)
    steps = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        column = work[k + 1:, k]
        # scaled first, so that tiny and huge columns neither vanish nor overflow in the norm
        scale = np.abs(column).max()
        if scale == 0 or not np.abs(column[1:]).max():
            continue
        v = column / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        steps[k, k + 1:] = v
        inner = work[k + 1:, k + 1:]
        w = inner @ v
        w -= (v @ w) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflected = column - 2 * v * (v @ column)
        work[k + 1:, k] = work[k, k + 1:] = 0
        work[k + 1, k] = work[k, k + 1] = reflected[0]
    return np.diag(work).copy(), np.diag(work, -1).copy(), steps


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: negative pivots of T - at I."""
    tiny = np.finfo(float).tiny / _EPS * max(1.0, float(np.max(off ** 2, initial=0.0)))
    pivot, below = np.ones_like(at), np.zeros(len(at), int)
    for d, e in zip(diagonal, np.concatenate([[0.0], off]), strict=True):
        pivot = d - at - e * e / pivot
        # a pivot of zero counts as negative, and the next one then as positive
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, all bisected at once inside the Gershgorin bounds."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    norm = max(float(np.abs(diagonal).max()), float(reach.max()), np.finfo(float).tiny)
    margin = _EPS * norm
    low = np.full(k, (diagonal - reach).min() - margin)
    high = np.full(k, (diagonal + reach).max() + margin)
    want = n - 1 - np.arange(k)  # so many eigenvalues lie below the wanted one
    while True:
        middle = low + (high - low) / 2
        if np.all((high - low <= 2 * _EPS * np.abs(middle) + _EPS / 16 * norm) | (middle <= low) | (middle >= high)):
            return middle
        above = sturm_count(diagonal, off, middle) > want
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift I) x = right by elimination with row exchanges; pivots below ``least`` are raised to it."""
    n = len(diagonal)
    main, up, up2, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        below, pivot = float(off[i]), main[i]
        if abs(below) > abs(pivot):
            factor = pivot / below
            main[i], up[i], main[i + 1], up2[i] = below, main[i + 1], up[i] - factor * main[i + 1], up[i + 1]
            up[i + 1] = -factor * up2[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(pivot) < least:
                pivot = main[i] = least
            factor = below / pivot
            main[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    out = np.empty(n)
    for i in range(n - 1, -1, -1):
        value = x[i]
        if i + 1 < n:
            value -= up[i] * out[i + 1]
        if i + 2 < n:
            value -= up2[i] * out[i + 2]
        out[i] = value / main[i]
    return out


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration.

    Values closer than a thousandth of the matrix's norm to their neighbour form a cluster; each vector of a cluster is
    made orthogonal to those before it in every iteration.
    """
    n = len(diagonal)
    norm = max(float((np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max()), np.finfo(float).tiny)
    random = np.random.default_rng(20240229)
    out = np.zeros((n, len(values)))
    first, last = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # equal values would give equal systems: keep the shifts apart by a few roundings
        shift = min(float(value), last - 10 * _EPS * norm) if k > first else float(value)
        last = shift
        vector = random.uniform(-1, 1, n)
        cluster = out[:, first:k]
        for _ in range(5):
            vector = _solve(diagonal, off, shift, vector / np.abs(vector).max(), _EPS * norm)
            vector /= np.abs(vector).max()
            for _ in range(2):
                vector = vector - cluster @ (cluster.T @ vector)
            vector /= np.linalg.norm(vector)
        out[:, k] = vector
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the ``k`` largest eigenvalues of symmetric ``matrix``."""
    k, scale = min(k, len(matrix)), float(np.abs(matrix).max())
    if not scale:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    # entries of about one: nothing below underflows
    diagonal, off, steps = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for v in steps[::-1]:
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * scale, vectors


# --- distributed sums -----------------------------------------------------------------------------------------------

def integer_vectors(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows that count, settled, their entries as exact longs."""
    c = F.col(vector)
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= LARGEST))
    scaled = F.transform(c, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")) + F.lit(SHIFT))
    rows = df.where(sound).select(F.col(row_id).alias("vec_id"), scaled.alias("x"))
    # a column of strings, structs and the like holds no vectors; Spark refuses it here
    rows = settle(rows.select("vec_id", F.col("x").cast("array<long>").alias("x")))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrix(column: pa.Array, d: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, d)


def _summed(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            if len(batch):
                # entries stay below 2 ** 47, a batch has far fewer than 2 ** 16 rows
                for part in np.array_split(_matrix(batch.column("x"), d, np.int64), -(-len(batch) // 2 ** 15)):
                    total = [a + int(b) for a, b in zip(total, part.sum(axis=0), strict=True)]
                    n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * d, pa.int64())],
                ["dimension", "total", "n"])
    return run


@dataclass(frozen=True)
class Centre:
    """Count and exact sums of all vectors."""
    n: int
    sums: tuple[int, ...]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit integers where they reach, Python's integers beyond."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums)) > _LONG:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, one rounding away from exact."""
        return (self.exact(x) / self.n).astype(float)


def centre_of(rows: DataFrame) -> Centre | None:
    """Count and sums of column ``x`` of :func:`integer_vectors`; None for no rows."""
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    parts = rows.select("x").mapInArrow(_summed(head["d"]), "dimension int, total string, n long")
    sums = parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    got = sums.orderBy("dimension").collect()  # one row per dimension
    return Centre(got[0]["n"], tuple(int(r["total"]) for r in got))


def _crossed(project, d: int):
    """Sum of the products of centred columns; one row per dimension from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            if len(batch):
                block = project(batch.column("x"))
                total, seen = total + block.T @ block, True
        if seen:
            flat = pa.array(total.reshape(-1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), rows], ["dimension", "products"])
    return run


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the matrix: the sum over all tasks, added batch by batch."""
    total: np.ndarray | None = None
    for batch in batches:
        rows = batch.column("products")
        part = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()])],
                                         ["dimension", "products"])


def covariance(rows: DataFrame, project, d: int, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of the ``d`` centred columns that ``project`` makes of column ``x``."""
    schema = "dimension int, products array<double>"
    parts = rows.select("x").mapInArrow(_crossed(project, d), schema)
    got = parts.groupBy("dimension").applyInArrow(_added, schema).collect()  # d rows of d numbers
    out = np.zeros((d, d))
    for r in got:
        out[r["dimension"]] = r["products"]
    out /= n
    return (out + out.T) / 2


# --- the operator ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Centre, components (columns, each over the root of its eigenvalue) and what they explain."""
    centre: Centre
    values: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.weights


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows`` of :func:`integer_vectors`; None for no rows."""
    centre = centre_of(rows)
    if centre is None:
        return None
    d = len(centre.sums)
    cov = covariance(rows, lambda column: centre.centred(_matrix(column, d, np.int64)), d, centre.n)
    values, vectors = leading_components(cov, components)
    real = values > max(values[0], 0.0) * d * _EPS * 4
    values, vectors = values[real], vectors[:, real]
    return Whitening(centre, values, vectors / np.sqrt(values), values / max(float(np.trace(cov)), np.finfo(float).tiny))


def _means(shared, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if len(batch):
                total += shared.value.whitened(_matrix(batch.column("x"), d, np.int64)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["component", "total"])
    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    d, k = len(model.centre.sums), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    sums = (rows.select("x").mapInArrow(_means(shared, d, k), "component int, total double")
            .groupBy("component").agg(F.sum("total").alias("total")).orderBy("component").collect())  # k rows
    mean = np.array([r["total"] for r in sums]) / model.centre.n
    cov = covariance(rows, lambda column: shared.value.whitened(_matrix(column, d, np.int64)) - mean, k, model.centre.n)
    shared.unpersist()
    return float(np.abs(cov - np.eye(k)).max())


_OUT = ("vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _squares(y: np.ndarray) -> pa.Array:
    """Sum of the squares of each row, exactly; null where 64 bits cannot hold it."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] <= _LONG:
        return pa.array((y * y).sum(axis=1), pa.int64())
    sums = [sum(v * v for v in row) for row in y.tolist()]
    return pa.array([v if v <= _LONG else None for v in sums], pa.int64())


def _projected(shared, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        d, k = model.weights.shape
        for batch in batches:
            # k rows for each vector: a thousand vectors at a time
            for start in range(0, len(batch), 1_000):
                part = batch.slice(start, 1_000)
                x = _matrix(part.column("x"), d, np.int64)
                deviation = _squares(model.centre.exact(x))
                each = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(k * len(part), model.centre.n)), deviation.take(each),
                    pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.explained, len(part))),
                    pa.array(np.full(k * len(part), error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Any other column of ``df``, whatever its name, is ignored. A deviation that does not fit 64 bits is null.
    """
    rows = integer_vectors(df, vector, row_id)
    schema = _OUT.format(id=rows.schema["vec_id"].dataType.simpleString())
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_projected(shared, error), schema)
