"""Embedding whitening by two passes over the vectors.

The first pass adds up each dimension as exact integers, which gives the mean. The second centres the vectors on it and
sums their outer products by matrix products, a block of rows at a time. Each task hands over one row a vector
length, and ``treeAggregate`` merges these on the executors, so that the driver gets one sum. LAPACK's
symmetric solver finds the components on the driver (a matrix of dimensions squared, whatever the rows), and the projection
goes back to the tasks as a broadcast variable of the same bound. A third pass measures how far the covariance of the whitened
values is from the identity.

An entry c becomes the integer floor(1024 * c) + 100000. Integers up to 2^40 are handled as 64-bit words, larger ones as
Python integers, in both cases exactly.

Vectors that are null or empty, or hold null, NaN or infinite entries, give no row, and neither do vectors with an entry
that is no 64-bit integer after scaling (2^53 and more). Vectors of another length are a fit list of their own, with their own n.
A component without variance (fewer rows than dimensions, equal vectors) has ``whitened`` null and isn't part of
``identity_error``; with no variance at all ``explained`` is 0. Repeated ids and null ids are rows of their own. Equal eigenvalues
keep the solver's order, the same for all rows. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = "op11_whitening"
COMPONENTS = 8
#: Rows of a block; bounds a task's memory for wide vectors.
BLOCK = 4096
_PLAIN = 1 << 40
_TOO_LARGE = 2.0**53
_LOW = (1 << 31) - 1
_MOST = 10**38


@dataclass
class Fit:
    """One vector length: x has the sums ``whole * n + rest``; ``directions`` are unit columns by falling ``values``."""

    n: int
    whole: list[int]
    rest: list[int]
    values: np.ndarray | None = None
    directions: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0


def blocks(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as double) of the usable rows of a list column, by length and in blocks."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or column.null_count == len(column):
        return []
    offsets, inner = column.offsets.to_numpy(), column.values
    values = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < _TOO_LARGE))])
    size = np.diff(offsets)
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    out = []
    for d in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == d))
        for lo in range(0, len(rows), BLOCK):
            at = rows[lo : lo + BLOCK]
            out.append((at, values[offsets[at][:, None] + np.arange(d)]))
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as int64, or as Python integers where that is past 2^40."""
    x = np.floor(vectors * 1024)
    if np.abs(x).max(initial=0) < _PLAIN:
        return x.astype(np.int64) + 100_000
    return np.array([[int(v) + 100_000 for v in row] for row in x], object)


def _sums(x: np.ndarray) -> list[int]:
    if x.dtype == object:
        return [int(v) for v in x.sum(0)]
    high = (x >> 31).sum(0).tolist()
    low = (x & _LOW).sum(0).tolist()
    return [(h << 31) + v for h, v in zip(high, low)]


def _offsets(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x less the whole part of the mean, exactly."""
    return x - np.array(fit.whole, x.dtype if x.dtype == object or max(map(abs, fit.whole)) < _PLAIN << 20 else object)


def centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    return y.astype(np.float64) - np.array([r / fit.n for r in fit.rest])


def deviations(y: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum of (n * y - rest)^2 over the dimensions, as n^2 * sum(y^2) - 2 * n * sum(y * rest) + sum(rest^2); None past 38 digits."""
    n, d = fit.n, y.shape[1]
    most = int(max(abs(y.max(initial=0)), abs(y.min(initial=0))))
    if most * most * d >= 1 << 62 or most * n * d >= 1 << 62:
        y = y.astype(object)
    rest = np.array(fit.rest, y.dtype)
    squares, mixed, last = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist(), sum(r * r for r in fit.rest)
    out = [n * n * a - 2 * n * b + last for a, b in zip(squares, mixed)]
    return [v if v < _MOST else None for v in out]


def _first_pass(batches):
    total: dict[int, list] = {}
    for batch in batches:
        for at, v in blocks(batch.column(0)):
            n, s = total.get(v.shape[1], (0, [0] * v.shape[1]))
            total[v.shape[1]] = (n + len(at), [a + b for a, b in zip(s, _sums(scaled(v)))])
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "sums": [list(map(str, s))]}, pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))


def _products(shared, project):
    """A task's sum, a vector length, of the outer products of ``project(centred vectors)``."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, v in blocks(batch.column(0)):
                fit = shared.value[v.shape[1]]
                z = project(centred(_offsets(scaled(v), fit), fit), fit)
                total[v.shape[1]] = total.get(v.shape[1], 0) + z.T @ z
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "product": [m.tobytes()]}, pa.schema([("d", pa.int32()), ("product", pa.binary())]))

    return run


def _merge(a: dict, b: dict) -> dict:
    for d, v in b.items():
        a[d] = a[d] + v if d in a else v
    return a


def _merge_sums(a: dict, b: dict) -> dict:
    for d, (n, s) in b.items():
        a[d] = (a[d][0] + n, [x + y for x, y in zip(a[d][1], s)]) if d in a else (n, s)
    return a


def _gather(vectors: DataFrame, shared, project) -> dict[int, np.ndarray]:
    rows = vectors.mapInArrow(_products(shared, project), "d int, product binary").rdd

    def add(total, r):
        m = np.frombuffer(bytes(r["product"]))
        side = int(round(len(m) ** 0.5))
        return _merge(total, {r["d"]: m.reshape(side, side)})

    return rows.treeAggregate({}, add, _merge)


def _whitened(c: np.ndarray, fit: Fit) -> np.ndarray:
    """Values of the components that have variance; the others are 0."""
    return (c @ fit.directions) / np.sqrt(np.where(fit.values > 0, fit.values, np.inf))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each vector length."""
    sc, v = vectors.sparkSession.sparkContext, vectors.select(column)
    sums = v.mapInArrow(_first_pass, "d int, n bigint, sums array<string>").rdd.treeAggregate({}, lambda t, r: _merge_sums(t, {r["d"]: (r["n"], [int(x) for x in r["sums"]])}), _merge_sums)
    fits = {d: Fit(n, [x // n for x in s], [x % n for x in s]) for d, (n, s) in sums.items()}
    for d, m in _gather(v, sc.broadcast(fits), lambda c, f: c).items():
        f = fits[d]
        covariance = (m + m.T) / (2 * f.n)
        values, directions = np.linalg.eigh(covariance)
        values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
        f.trace = float(np.trace(covariance))
        # what rounding leaves of a direction without variance is no variance
        f.values = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0)
        f.directions = np.ascontiguousarray(directions)
    for d, m in _gather(v, sc.broadcast(fits), _whitened).items():
        on = fits[d].values > 0
        fits[d].identity_error = float(np.abs(m[np.ix_(on, on)] / fits[d].n - np.eye(on.sum())).max(initial=0))
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Fit], id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_column, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    ``deviation`` is decimal(38, 0), so that it is exact past 64 bits.
    """
    shared, kind = vectors.sparkSession.sparkContext.broadcast(fits), dict(vectors.select(id_column).dtypes)[id_column]

    def run(batches):
        for batch in batches:
            for at, v in blocks(batch.column(1)):
                f = shared.value[v.shape[1]]
                y = _offsets(scaled(v), f)
                k = len(f.values)
                zero = np.tile(f.values == 0, len(at))
                wide = lambda values, kind: pa.array(np.tile(np.array(values), len(at)), kind)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), wide(range(1, k + 1), pa.int32()), wide([f.n] * k, pa.int64()),
                    pa.array(deviations(y, f), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(_whitened(centred(y, f), f).ravel(), pa.float64(), mask=zero),
                    wide([e / f.trace if f.trace > 0 else 0.0 for e in f.values], pa.float64()), wide([f.identity_error] * k, pa.float64()),
                ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"key {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.select(id_column, column).mapInArrow(run, schema).withColumnRenamed("key", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where 64 bits can't hold it (the operator's decimal does)."""
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
