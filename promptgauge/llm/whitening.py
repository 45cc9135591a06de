"""Whitened leading components of embeddings, by slicing the spectrum of their covariance.

Vectors are put on a grid of whole numbers, ``x = floor(scale * component)``. The fit list holds each distinct grid
vector once; a distinct aggregation makes it, so copies collapse before anything is shuffled. All sums over the list
are whole numbers and exact: the sums per dimension, and the products of the vectors less their rounded mean. Partial
sums leave each task, and the result is the same for every partitioning. The covariance follows from them with one
rounding per entry. It is the only thing that the driver holds: dimensions times dimensions.

``spectrum`` finds the leading eigenpairs of the covariance. A factorisation L D Lᵀ of the covariance less a shift has as
many positive entries in D as there are eigenvalues above the shift (law of inertia). Bisection by such counts cuts
the spectrum into slices until one holds just the wanted eigenvalue. Rayleigh quotient iteration, which
reuses the factorisation to solve, then converges cubically; a quotient that leaves its slice sends the search back
to bisection. Two last counts just below and above the eigenvalue certify that it has the number it was given.

Every row is then projected where it lies. ``identity_error`` is measured: one more pass over the fit list sums the
products of the whitened values.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries drop out, and so do vectors
with an entry whose scaled value is beyond 2^53, which has no exact whole number, and vectors of another length than
most vectors of the list (of lengths equally frequent the larger one counts). Ids may repeat or be null; equal rows
give equal results. Components with no spread beyond rounding are left out, so one distinct vector, or an empty
table, gives no rows. The entry of largest magnitude of a component is positive. Equal eigenvalues get orthogonal
components of their common space. ``deviation`` is null where it has more than 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from promptgauge.llm.batches import arrow_map
from promptgauge.session import written

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
_EXACT = 1 << 53
_WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the fit list's size, sums and rounded mean, and the leading eigenpairs."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one component per column
    trace: float
    identity_error: float


def on_grid(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the usable rows as whole numbers."""
    held = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c * scale) < float(_EXACT), F.lit(False)) & ~F.isnan(c))
    return held.filter((F.size("v") > 0) & usable).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of whole numbers without rounding, as Python integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
    return a.astype(object) @ b.astype(object)


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """``part`` of the list's matrix summed over all of it; only the sums of each task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, dims):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total.tolist()), pa.decimal128(38))], names=["i", "total"])

    parts = arrow_map(fit, run, _parse_datatype_string("i int, total decimal(38,0)"))
    return [int(r[1]) for r in parts.groupBy("i").agg(F.sum("total")).orderBy("i").collect()]  # as many rows as sums


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """Size, sums, rounded mean and covariance (divisor n) of the list ``fit(x)``."""
    n, *sums = _totals(fit, dims, lambda x: _exact_product(np.ones((1, len(x)), np.int64), np.c_[np.ones(len(x), np.int64), x])[0])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(dims)

    def products(x: np.ndarray) -> np.ndarray:
        y = x - np.array(centre, np.int64)
        return _exact_product(y.T, y)[upper]

    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    found = np.zeros((dims, dims))
    for i, j, total in zip(*upper, _totals(fit, dims, products), strict=True):
        found[i, j] = found[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    return n, sums, centre, found


class Factored:
    """L D Lᵀ of a symmetric matrix with symmetric pivoting: its inertia, and solutions of systems with it."""

    def __init__(self, matrix: np.ndarray):
        a, size = matrix.copy(), len(matrix)
        tiny = EPS * max(float(np.abs(matrix).max(initial=0)), float(np.finfo(float).tiny) / EPS)
        self.order, self.blocks = np.arange(size), []
        k = 0
        while k < size:
            width, other = self._pivot(a, k)
            if other != k + width - 1:
                self._swap(a, k + width - 1, other)
            d = a[k : k + width, k : k + width].copy()
            if width == 1 and abs(d[0, 0]) < tiny:
                d[0, 0] = tiny
            self.blocks.append((k, d))
            below = a[k + width :, k : k + width].copy()
            lower = np.linalg.solve(d, below.T).T
            a[k + width :, k + width :] -= lower @ below.T
            a[k + width :, k : k + width] = lower
            k += width
        self.lower = np.tril(a, -1)
        for k, d in self.blocks:
            if len(d) == 2:
                self.lower[k + 1, k] = 0.0
        np.fill_diagonal(self.lower, 1.0)

    @staticmethod
    def _pivot(a: np.ndarray, k: int) -> tuple[int, int]:
        """The width of the next pivot, and the row that goes last into it; keeps the factors from growing."""
        if k == len(a) - 1:
            return 1, k
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax())
        most, bound = column[r - k - 1], (1 + 17**0.5) / 8
        if most == 0 or abs(a[k, k]) >= bound * most:
            return 1, k
        row = np.abs(a[k:, r])
        row[r - k] = 0
        if abs(a[k, k]) * row.max() >= bound * most**2:
            return 1, k
        return (1, r) if abs(a[r, r]) >= bound * row.max() else (2, r)

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]
        self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """How many eigenvalues of the matrix are above zero."""
        return sum(int((np.linalg.eigvalsh(d) > 0).sum()) if len(d) == 2 else int(d[0, 0] > 0) for _, d in self.blocks)

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.linalg.solve(self.lower, b[self.order])
        for k, d in self.blocks:
            x[k : k + len(d)] = np.linalg.solve(d, x[k : k + len(d)])
        found = np.empty_like(x)
        found[self.order] = np.linalg.solve(self.lower.T, x)
        return found


class Slices:
    """Counts of the eigenvalues above shifts of a matrix, and the slices that the counts cut."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.size = matrix, len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max())
        self.counts = {-2 * self.norm: self.size, 2 * self.norm: 0}

    def shifted(self, shift: float) -> Factored:
        return Factored(self.matrix - shift * np.eye(self.size))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.shifted(shift).positive()
        return self.counts[shift]

    def around(self, number: int) -> tuple[float, float]:
        """The narrowest known slice that holds eigenvalue ``number`` (from 1, falling)."""
        return max(s for s, c in self.counts.items() if c >= number), min(s for s, c in self.counts.items() if c < number)

    def isolated(self, number: int, width: float) -> tuple[float, float]:
        """A slice no wider than ``width`` times the eigenvalue, with no other in it unless they agree to rounding."""
        while True:
            low, high = self.around(number)
            alone = self.counts[low] - self.counts[high] == 1 and high - low <= width * max(abs(low), abs(high))
            if alone or high - low <= 4 * EPS * self.norm:
                return low, high
            self.above((low + high) / 2)


def spectrum(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit eigenvectors as columns; only values above rounding."""
    slices, values, vectors = Slices(matrix), [], np.zeros((len(matrix), 0))
    for number in range(1, min(components, len(matrix)) + 1):
        if slices.norm == 0 or slices.above(4 * len(matrix) * EPS * slices.norm) < number:
            break
        value, vector = _eigenpair(slices, number, vectors)
        values.append(value)
        vectors = np.c_[vectors, vector * np.sign(vector[np.abs(vector).argmax()])]
    return np.array(values), vectors


def _eigenpair(slices: Slices, number: int, before: np.ndarray) -> tuple[float, np.ndarray]:
    matrix, width = slices.matrix, 0.125
    while True:
        low, high = slices.isolated(number, width)
        x = _unit(np.random.default_rng(number).standard_normal(slices.size), before)
        start = slices.shifted((low + high) / 2)
        for _ in range(2):  # towards the eigenvector nearest to the middle of the slice
            x = _unit(start.solve(x), before)
        value, residual = _quotient(matrix, x)
        while low <= value <= high or high - low <= 8 * EPS * slices.norm:
            y = _unit(slices.shifted(value).solve(x), before)
            new, left = _quotient(matrix, y)
            if left >= residual / 2:
                break
            x, value, residual = y, new, left
        slack = max(residual, 4 * slices.size * EPS * slices.norm)
        if residual <= 64 * EPS * slices.norm * slices.size**0.5 and slices.above(value - slack) >= number > slices.above(value + slack):
            return value, x
        if high - low <= 4 * EPS * slices.norm:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        width = (high - low) / max(abs(low), abs(high)) / 4  # look closer


def _unit(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    x = x / np.linalg.norm(x)
    for _ in range(2):
        x = x - before @ (before.T @ x)
    return x / np.linalg.norm(x)


def _quotient(matrix: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    product = matrix @ x
    value = float(x @ product)
    return value, float(np.linalg.norm(product - value * x))


def _projected(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """The whitened values of rows on the grid; a whole number is taken off first, then the rest of the mean."""
    rest = np.array([(s - fitted.n * c) / fitted.n for s, c in zip(fitted.sums, fitted.centre, strict=True)])
    return ((x - np.array(fitted.centre, np.int64)) - rest) @ (fitted.vectors / np.sqrt(fitted.values))


def fitted_on(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``grid(x)``, or None if there is no spread."""
    distinct = written(grid.select("x").distinct(), "fit-list")
    sizes = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims = sizes["dims"]
    fit = distinct.filter(F.size("x") == dims)
    n, sums, centre, matrix = covariance(fit, dims)
    values, vectors = spectrum(matrix, components)
    if not len(values):
        return None
    found = Whitening(n, sums, centre, values, vectors, float(np.trace(matrix)), 0.0)
    return Whitening(**{**found.__dict__, "identity_error": _identity_error(fit, found)})


def _identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """How far the whitened list's covariance is from the identity, at most, by a pass over the list."""
    dims, many = len(fitted.sums), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many + 1, many + 1))
        for _, x in _matrices(batches, dims):
            w = np.c_[_projected(x, fitted), np.ones(len(x))]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "total"])

    parts = arrow_map(fit, run, _parse_datatype_string("i int, total double")).groupBy("i").agg(F.sum("total")).orderBy("i").collect()
    total = np.array([r[1] for r in parts]).reshape(many + 1, many + 1) / fitted.n
    return float(np.abs(total[:many, :many] - np.outer(total[:many, many], total[:many, many]) - np.eye(many)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    ``deviation`` is the sum over the dimensions of ``(n * x - sum) ** 2``, exact.
    """
    grid = on_grid(vectors, scale, id_col, vector_col)
    schema = StructType([grid.schema["vec_id"], *_parse_datatype_string(_WHITENED).fields])
    fitted = fitted_on(grid, components)
    if fitted is None:
        return grid.sparkSession.createDataFrame([], schema)
    dims, many = len(fitted.sums), len(fitted.values)
    rest = np.array([s - fitted.n * c for s, c in zip(fitted.sums, fitted.centre, strict=True)], np.int64)
    offset = sum(int(r) ** 2 for r in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = fitted.n
        for batch, x in _matrices(batches, dims):
            y = x - np.array(fitted.centre, np.int64)
            if int(np.abs(y).max()) ** 2 * dims < _EXACT:
                squares = (y * y).sum(axis=1).tolist()
            else:
                squares = [sum(v * v for v in row) for row in y.tolist()]
            mixed = _exact_product(y, rest[:, None])[:, 0].tolist()
            deviations = [n * n * q - 2 * n * p + offset for q, p in zip(squares, mixed, strict=True)]
            exact = pa.array([Decimal(d) if d < 10**38 else None for d in deviations], pa.decimal128(38))
            rows = np.repeat(np.arange(len(x)), many)
            columns = [
                batch.column("vec_id").take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n)),
                exact.take(pa.array(rows)),
                pa.array(_projected(x, fitted).ravel()),
                pa.array(np.tile(fitted.values / fitted.trace, len(x))),
                pa.array(np.full(len(rows), fitted.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(grid.filter(F.size("x") == dims), run, schema)
