"""PCA whitening of embeddings with mixed-precision eigenvectors.

Vectors become whole numbers, x = floor(``SCALE`` * c) + ``SHIFT``. Tasks add up sums and,
around whole-number centres near the means, products of two dimensions; both are exact
(blocks of rows small enough for doubles, then decimals), so the covariance V is known
exactly and does not depend on the order of rows. Only sums by dimension and by pair of
dimensions reach the driver.

Eigenvectors of V are first computed in float32, then corrected by the iterations of
Ogita and Aishima, which are matrix products only, in extended precision: R = I - X'X
and S = X'VX tell how far X is from orthogonal and S from diagonal, and each pair of
columns with distinct eigenvalues is turned by what the two say. A cluster of eigenvalues
that are closer than the error of X cannot be told apart that way: the vectors span the
right space, and a small eigenproblem inside it, of V less the cluster's mean, gives
vectors for the next iteration.

Components are numbered from 1 by falling eigenvalue; the largest entry of each is
positive. A whitened value is (x - mean) on a component over the square root of its
eigenvalue. ``identity_error`` is measured on the whitened values of all rows in a pass
of its own.

Defined cases: rows whose vector is null or empty or holds a null, NaN or infinite entry
are dropped, and so are vectors that do not have the most frequent length (the longer of
two). Entries beyond 2**55 count as that. Equal rows count each. A component without variance
(below ``LEAST_PART`` of all) has null whitened values and no part in ``identity_error``;
without any variance ``explained`` and ``identity_error`` are null. A deviation beyond 64
bits is null. An empty table gives an empty result. Other columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.common import quoted, slices
from clientpulse.session import ship_package

SCALE = 64
SHIFT = 1_000_000
MOST_COMPONENTS = 32
MOST_ENTRY = float(2**55)
LEAST_PART = 1e-13
#: Iterations double the right digits of float32; the rest is for clusters.
MOST_ROUNDS = 30
SUM = pa.decimal128(38, 0)
SLICE = 1024


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: the exact means as centre + rest / n, and the components."""

    n: int
    centre: np.ndarray  # whole numbers
    rest: np.ndarray  # sums of x - centre, whole numbers
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues, falling
    trace: float

    def parts(self) -> np.ndarray:
        """Projection of centred x to whitened values; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            roots = np.where(self.has_variance(), np.sqrt(np.maximum(self.values, 0)), np.nan)
            return self.vectors / roots

    def has_variance(self) -> np.ndarray:
        return self.values > LEAST_PART * self.trace


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that stay, vectors as doubles."""
    ship_package(rows.sparkSession)
    vector = quoted(vector_col).cast("array<double>")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        rows.select(quoted(id_col).alias("vec_id"), vector.alias("vector"))
        .where("vector is not null and size(vector) > 0")
        .where(~bad)
    )


def whole(column: pa.Array, size: int) -> np.ndarray:
    entries = np.clip(column.flatten().to_numpy(zero_copy_only=False), -MOST_ENTRY, MOST_ENTRY)
    return (np.floor(SCALE * entries).astype(np.int64) + SHIFT).reshape(-1, size)


def exact_sums(values: np.ndarray) -> list[int]:
    """Column sums of whole numbers; in halves, so that they fit."""
    low = (values & 0xFFFFFFFF).sum(axis=0)
    return [int(h) * (1 << 32) + int(w) for h, w in zip((values >> 32).sum(axis=0), low)]


def sums(size: int):
    """(i, n, total) of a task: the sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * size, 0
        for batch in slices(batches, SLICE):
            x = whole(batch.column(0), size)
            n += len(x)
            total = [a + b for a, b in zip(total, exact_sums(x))]
        if n:
            arrays = [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total, SUM)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "n", "total"])

    return run


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, as Python integers where they may pass doubles."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    whole_numbers = y.astype(object)
    return whole_numbers.T.dot(whole_numbers)


def products(size: int, centre: np.ndarray):
    """(i, j, total) of a task: sums of products of dimensions i <= j around the centre."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, SLICE):
            found = exact_products(whole(batch.column(0), size) - centre)
            total = found if total is None else total + found
        if total is not None:
            arrays = [*(pa.array(x, pa.int32()) for x in upper), pa.array([int(v) for v in total[upper]], SUM)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "total"])

    return run


def extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def clusters_of(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Indices of the groups of two or more values in a chain of steps within ``gap``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``v`` (extended precision) from approximate ones."""
    x = x.astype(np.longdouble)
    eye = np.eye(len(v), dtype=np.longdouble)
    norm = np.abs(v).sum(axis=1).max()
    tiny = np.finfo(np.longdouble).eps * norm * len(v)
    best, values = None, np.diag(v).copy()
    for _ in range(MOST_ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (v @ x)
        s = (s + s.T) / 2  # so that turns stay orthogonal
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        gap = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        step = values[None, :] - values[:, None]
        apart = np.abs(step) > gap
        turn = np.where(apart, (s + values[None, :] * r) / np.where(apart, step, 1), r / 2)
        x = x + x @ turn
        size = np.abs(turn).max()
        for group in clusters_of(values, gap):
            if np.abs(off[np.ix_(group, group)]).max() <= tiny:
                continue  # solved; of equal eigenvalues any vectors of the space will do
            inside = x[:, group]
            middle = values[group].mean()
            small = inside.T @ (v @ inside - middle * inside)
            scale = np.abs(small).max()
            if scale > tiny:
                _, w = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))
                x[:, group] = inside @ w.astype(np.longdouble)
                size = max(size, np.longdouble(1e-8))
        if best is not None and size >= best and size < 1e-12:
            break
        best = size
    return values, x


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors, corrected to double precision."""
    scale = np.abs(v).max()
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = v / scale
    _, x = np.linalg.eigh(scaled.astype(np.float32))
    values, x = refined(scaled, x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return values.astype(np.float64), (x * sign).astype(np.float64)


def fit(vectors: DataFrame, size: int, components: int = MOST_COMPONENTS) -> Whitening | None:
    """The whitening of the ``vector`` column, all of length ``size``."""
    rows = vectors.select("vector")
    # as many rows as dimensions, then as many as pairs of them
    found = rows.mapInArrow(sums(size), "i int, n bigint, total decimal(38,0)")
    first = {r.i: r for r in found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    if not first:
        return None
    n = first[0].n
    centre = [int(first[i].total) // n for i in range(size)]
    rest = [int(first[i].total) - n * centre[i] for i in range(size)]
    found = rows.mapInArrow(products(size, np.array(centre, dtype=np.int64)), "i int, j int, total decimal(38,0)")
    v = np.zeros((size, size), dtype=np.longdouble)
    trace = Fraction(0)
    for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        exact = Fraction(n * int(r.total) - rest[r.i] * rest[r.j], n * n)
        v[r.i, r.j] = v[r.j, r.i] = extended(exact)
        trace += exact if r.i == r.j else 0
    values, x = eigenpairs(v)
    k = min(components, size)
    return Whitening(n, np.array(centre, dtype=np.int64), np.array(rest, dtype=np.int64), x[:, :k], values[:k], float(trace))


def whitened(model: Whitening, y: np.ndarray) -> np.ndarray:
    return (y - model.rest / model.n) @ model.parts()


def deviations(model: Whitening, y: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)**2, exact; null beyond 64 bits."""
    most = (int(np.abs(y).max(initial=0)) + 1) * model.n
    if most * most * y.shape[1] < 1 << 63:
        d = model.n * y - model.rest
        return (d * d).sum(axis=1).tolist()
    d = model.n * y.astype(object) - model.rest.astype(object)
    found = (d * d).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in found]


def squares(model: Whitening):
    """(i, j, mean_part, total) of a task: sums of whitened values and of their products."""
    size, k = len(model.centre), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in slices(batches, SLICE):
            z = whitened(model, whole(batch.column(0), size) - model.centre)
            total += z.T @ z
            mean += z.sum(axis=0)
        i, j = np.indices((k, k)).reshape(2, -1)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(mean[i]), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "mean_part", "total"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened values' covariance less the identity."""
    k = len(model.values)
    covariance, mean = np.zeros((k, k)), np.zeros(k)
    found = vectors.select("vector").mapInArrow(squares(model), "i int, j int, mean_part double, total double")
    for r in found.groupBy("i", "j").agg(F.sum("mean_part").alias("m"), F.sum("total").alias("t")).collect():
        covariance[r.i, r.j] = r.t / model.n
        mean[r.i] = r.m / model.n
    keep = model.has_variance()
    if not keep.any():
        return None
    error = covariance - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(error[np.ix_(keep, keep)]).max())


def row_batches(model: Whitening, error: float | None):
    size, k = len(model.centre), len(model.values)
    explained = pa.array(model.values / model.trace if model.trace else [None] * k, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            y = whole(batch.column(1), size) - model.centre
            z = whitened(model, y).ravel()
            of_row = pa.array(np.repeat(np.arange(len(y)), k))
            of_component = pa.array(np.tile(np.arange(k), len(y)))
            arrays = [
                batch.column(0).take(of_row),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(z), model.n, dtype=np.int64)),
                pa.array(deviations(model, y), pa.int64()).take(of_row),
                pa.array(z, mask=np.isnan(z)),
                explained.take(of_component),
                pa.array([error] * len(z), pa.float64()),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def whitened_rows(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = MOST_COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each valid
    row and component."""
    valid = valid_vectors(rows, id_col, vector_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = valid.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    valid = valid.where(F.size("vector") == usual["size"])
    model = fit(valid, usual["size"], components)
    return valid.mapInArrow(row_batches(model, identity_error(valid, model)), schema)
