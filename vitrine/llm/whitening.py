"""Embedding whitening by spectrum slicing.

Vectors are put on an integer grid, so that equal vectors are equal exactly and sums are
exact; the fit list is each distinct grid vector once. The leading eigenvalues of its
covariance are isolated by counting: an LDLᵀ factorisation of ``V - s I`` has as many positive
pivots as ``V`` has eigenvalues over ``s`` (law of inertia), so bisection on ``s`` ends in an
interval that holds one eigenvalue only. Rayleigh quotient iteration then converges cubically to
its vector, and counts on both sides of the result certify that it is the k-th largest.

The vectors never leave the executors: sums and centred products are added per task and then by
Spark, per dimension; the driver sees one D x D matrix.

Defined results: vectors that are null, hold a null, NaN or infinite entry, or have another length
than most (the shorter of equally frequent ones) are dropped; grid values are held within
``LARGEST``; rows with null or repeated ids and repeated vectors are each returned; components
whose eigenvalue is no larger than rounding are left out, so a table of equal vectors (or an empty
one) gives no rows; a ``deviation`` beyond a long is null; equal eigenvalues get some orthonormal
vectors of their space; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.arrays import bounded_batches
from vitrine.operators.materialize import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 1 << 52          # of a grid value, so that it is exact as a double
_LOW_BITS = 26             # sums are kept as high and low parts, so that none overflows
_LONG = float(1 << 62)
_PIVOT = (1 + np.sqrt(17)) / 8


def positive_pivots(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` over ``shift``, by LDLᵀ with diagonal pivoting.

    Pivots are single entries or 2 x 2 blocks, chosen so that the factors stay bounded; such
    a block always has one eigenvalue on either side of zero.
    """
    a = a - shift * np.eye(len(a))
    n, at, count = len(a), 0, 0
    while at < n:
        size, below = 1, np.abs(a[at + 1:, at])
        if len(below) and below.max() > 0:
            far = at + 1 + int(below.argmax())
            if abs(a[at, at]) < _PIVOT * below.max():
                row = np.abs(a[far, at:])
                row[far - at] = 0
                if abs(a[at, at]) * row.max() < _PIVOT * below.max() ** 2:
                    size = 1 if abs(a[far, far]) >= _PIVOT * row.max() else 2
                    one = at + size - 1
                    a[[one, far]] = a[[far, one]]
                    a[:, [one, far]] = a[:, [far, one]]
        if size == 1:
            count += bool(a[at, at] > 0)
            if a[at, at] != 0:
                column = a[at + 1:, at]
                a[at + 1:, at + 1:] -= np.outer(column, column / a[at, at])
        else:
            count += 1
            columns = a[at + 2:, at:at + 2]
            a[at + 2:, at + 2:] -= columns @ np.linalg.solve(a[at:at + 2, at:at + 2], columns.T)
        at += size
    return count


@dataclass(frozen=True)
class Slice:
    """One eigenpair; ``above`` and ``below`` are the counts over ``value ± error``."""

    value: float
    vector: np.ndarray
    error: float
    above: int
    below: int


def leading_eigenpairs(v: np.ndarray, k: int) -> list[Slice]:
    """The ``k`` largest eigenvalues of ``v`` with unit vectors, largest first."""
    radius = np.abs(v).sum(1) - np.abs(np.diag(v))
    norm = max(float(np.abs(v).sum(1).max()), np.finfo(float).tiny)
    low, high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
    known = {low - 1e-3 * norm: len(v), high + 1e-3 * norm: 0}      # shift -> eigenvalues over it

    def over(shift: float) -> int:
        if shift not in known:
            known[shift] = positive_pivots(v, shift)
        return known[shift]

    found: list[Slice] = []
    tiny, rng = 64 * np.finfo(float).eps * norm, np.random.default_rng(12)
    for number in range(1, min(k, len(v)) + 1):
        first = True
        while True:
            a = max(s for s, n in known.items() if n >= number)
            b = min(s for s, n in known.items() if n < number and s > a)
            alone = known[a] == number and known[b] == number - 1
            if b - a > tiny and not (alone and (first or b - a < 1e-3 * abs(b))):
                over((a + b) / 2)
                continue
            got = _rayleigh(v, (a + b) / 2, [f.vector for f in found], rng, norm)
            if got and a - tiny <= got[0] <= b + tiny:
                value, vector, error = got
                error = max(4 * error, tiny)
                above, below = over(value + error), over(value - error)
                if above < number <= below:
                    found.append(Slice(value, vector, error, above, below))
                    break
            if b - a <= tiny:
                raise ArithmeticError(f"eigenvalue {number} cannot be isolated")
            first = False
            over((a + b) / 2)
    return found


def _rayleigh(v: np.ndarray, shift: float, others: list[np.ndarray], rng: np.random.Generator,
              norm: float) -> tuple[float, np.ndarray, float] | None:
    """Rayleigh quotient iteration from ``shift``, orthogonal to ``others``."""
    basis = np.array(others).reshape(-1, len(v))

    def unit(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    x, best = unit(rng.normal(size=len(v))), None
    for step in range(40):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:                    # the shift is an eigenvalue exactly
            y = np.linalg.solve(v - (shift + 1e-15 * norm) * np.eye(len(v)), x)
        if not np.isfinite(y).all():
            return best
        x = unit(y)
        value = float(x @ v @ x)
        error = float(np.linalg.norm(v @ x - value * x))
        if best is not None and error >= best[2] and best[2] < 1e-12 * norm:
            break
        if best is None or error < best[2]:
            best = value, x, error
        if step >= 2:                                    # first steps keep the slice's own shift
            shift = value
    return best


@dataclass(frozen=True)
class Whitening:
    n: int                    # distinct vectors
    sums: list[int]           # S, exact
    trace: float
    slices: list[Slice]

    @property
    def axes(self) -> np.ndarray:
        """Components as columns, each divided by the root of its eigenvalue."""
        return np.column_stack([s.vector / np.sqrt(s.value) for s in self.slices])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``x - S/n`` as doubles, and the exact parts ``x - S // n`` and ``S % n``."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        part = x - whole
        return part - rest / self.n, part, rest

    def deviations(self, part: np.ndarray, rest: np.ndarray) -> list[int | None]:
        """Sums of ``(n x - S)^2``, exact; None beyond a long."""
        largest = float(np.abs(part).max(initial=0)) * self.n + self.n
        if largest * largest * max(1, part.shape[1]) < _LONG:
            off = part * np.int64(self.n) - rest
            return (off * off).sum(1).tolist()
        out = [sum((int(p) * self.n - int(r)) ** 2 for p, r in zip(row, rest)) for row in part]
        return [d if d < 1 << 63 else None for d in out]


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def grid_vectors(vectors: DataFrame, column: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Rows with a usable vector, and ``x``: its entries times ``scale``, floored, plus ``offset``."""
    # a bound on both sides also refuses NaN, which is larger than any number
    finite = f"NOT exists({column}, c -> c IS NULL OR NOT (abs(double(c)) < double('Infinity')))"
    grid = (f"transform({column}, c -> greatest(least(bigint(floor(least(greatest("
            f"double(c) * {scale}, -1e17D), 1e17D))) + {offset}, {LARGEST}), -{LARGEST}))")
    return vectors.where(F.col(column).isNotNull()).where(finite).withColumn("x", F.expr(grid))


def _added(parts: DataFrame, width: int) -> np.ndarray | None:
    """Rows ``at, v`` of the tasks added per ``at`` by Spark, as a matrix."""
    rows = parts.groupBy("at").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).toArrow()
    if not rows.num_rows:
        return None
    out = np.column_stack([rows.column(f"v{k}").to_numpy() for k in range(width)])
    return out[np.argsort(rows.column("at").to_numpy())]


def _emit(sums: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums.tolist(), pa.list_(kind))],
        names=["at", "v"])


def fit_whitening(fit_list: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit to the rows ``x`` (distinct vectors of ``dims`` entries); None without a spread."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims, 3), np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            sums += np.column_stack([(x >> _LOW_BITS).sum(0), (x & ((1 << _LOW_BITS) - 1)).sum(0),
                                     np.full(dims, len(x))])
        yield _emit(sums, pa.int64())

    found = _added(fit_list.mapInArrow(add, "at int, v array<bigint>"), 3)
    if found is None or not found[0, 2]:
        return None
    n, sums = int(found[0, 2]), [(int(h) << _LOW_BITS) + int(low) for h, low, _ in found]
    plain = Whitening(n, sums, 0.0, [])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            off = plain.centred(_matrix(batch, dims))[0]
            total += off.T @ off
        yield _emit(total, pa.float64())

    v = _added(fit_list.mapInArrow(products, "at int, v array<double>"), dims) / n
    v, trace = (v + v.T) / 2, float(np.trace(v))
    slices = leading_eigenpairs(v, components) if trace > 0 else []
    floor = 1e-12 * len(v) * trace
    slices = [s if s.vector[np.abs(s.vector).argmax()] > 0 else
              Slice(s.value, -s.vector, s.error, s.above, s.below) for s in slices if s.value > floor]
    return Whitening(n, sums, trace, slices) if slices else None


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the fit list's whitened covariance minus the identity."""
    k, dims = len(model.slices), len(model.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.centred(_matrix(batch, dims))[0] @ model.axes
            total += np.vstack([w.T @ w, w.sum(0)])
        yield _emit(total, pa.float64())

    added = _added(fit_list.mapInArrow(products, "at int, v array<double>"), k) / model.n
    mean = added[k]                          # rounding only, since the vectors are centred
    return float(np.abs(added[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Whitened coordinates of every usable row on the leading components.

    Returns ``id, component, n, deviation, whitened, explained, identity_error``, the id
    under its own name.
    """
    bounded_batches(vectors)
    key, spark = vectors.schema[id_column], vectors.sparkSession
    rows = grid_vectors(vectors.select(F.col(id_column).alias("id"), F.col(column).alias("c")), "c",
                        scale, offset).select("id", "x")
    schema = (f"id {key.dataType.simpleString()}, component int, n bigint, deviation bigint, "
              "whitened double, explained double, identity_error double")
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(
        F.desc("rows"), "dims").limit(1).collect()
    dims, model = sizes[0].dims if sizes else 0, None
    if dims:
        rows = rows.where(F.size("x") == dims)
        fit_list = materialize(rows.select("x").distinct(), "grid-vectors")
        model = fit_whitening(fit_list, dims, components)
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    error, shares = identity_error(fit_list, model), [s.value / model.trace for s in model.slices]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, axes = len(model.slices), model.axes
        for batch in batches:
            off, part, rest = model.centred(_matrix(batch, dims))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(off)), k)))
            deviation = pa.array(model.deviations(part, rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))),
                 pa.array(np.full(len(off) * k, model.n)),
                 deviation.take(pa.array(np.repeat(np.arange(len(off)), k))),
                 pa.array((off @ axes).ravel()), pa.array(np.tile(shares, len(off))),
                 pa.array(np.full(len(off) * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_column)
