"""Whitening of embeddings: the leading components of their covariance by FEAST contour integration.

Spark makes the fit list (each distinct vector once), its sums and its covariance: a task multiplies its own rows, and a
d x d matrix of sums is all that a task sends on and all that the driver gets.  There, an interval of eigenvalues is found
by inertia counts (signs of the pivots of LDL^T of shifted covariances), cut into intervals of a few eigenvalues each, and
in each of them the spectral projector, a contour integral of the resolvent, is applied to a random subspace by Gauss-Legendre
quadrature: one complex shifted solve a node.  Rayleigh-Ritz extracts eigenpairs from the filtered subspace, which is
filtered again until residuals are at rounding level.  As many eigenpairs as the inertia counts say must come out of every
interval; where fewer do, the subspace is enlarged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import dropped, tidied, written

SCALE = 256
#: Eigenvalues an interval, quadrature nodes on the upper half of a contour, and filter steps at most.
FEW, NODES, STEPS = 8, 12, 40
#: Bunch and Parlett's bound between pivots of one row and of two; where an interval is cut, no simple fraction.
PIVOT, CUT = (1 + 17**0.5) / 8, 0.4871932
#: Of the largest eigenvalue: what counts as none, and the width under which an interval isn't cut further.
NOTHING, NARROW = 1e-12, 1e-11


def positive_count(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: Sylvester's law over LDL^T with pivots of one or two rows."""
    a, count = np.array(matrix, np.float64), 0
    while len(a):
        flat = np.abs(a)
        own = np.diagonal(flat).copy()
        np.fill_diagonal(flat, 0)
        p, (r, c) = int(own.argmax()), divmod(int(flat.argmax()), len(a))
        if own[p] == 0 and flat[r, c] == 0:
            break
        one = own[p] >= PIVOT * flat[r, c]
        pivot = [p] if one else [r, c]
        count += int(a[p, p] > 0) if one else 1  # a pivot of two rows has one positive and one negative eigenvalue
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return count


def intervals(matrix: np.ndarray, wanted: int, few: int = FEW) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, that hold the ``wanted`` largest eigenvalues above NOTHING, and a few more at most."""
    n = len(matrix)
    off = np.abs(matrix).sum(axis=1) - np.abs(np.diagonal(matrix))
    top = float((np.diagonal(matrix) + off).max()) * (1 + 1e-9)  # Gershgorin
    above = lambda x: positive_count(matrix - x * np.eye(n))
    if top <= 0:
        return []
    largest, ceiling = 0.0, top  # the largest eigenvalue, roughly: NOTHING and NARROW are shares of it
    while ceiling - largest > 0.5 * ceiling and ceiling > 1e-290:
        middle = largest + (ceiling - largest) * CUT
        largest, ceiling = (middle, ceiling) if above(middle) else (largest, middle)
    floor = NOTHING * ceiling
    most = above(floor)
    wanted = min(wanted, most)
    if not wanted:
        return []
    low, high, inside = floor, top, most
    while inside > wanted + few // 2 and high - low > NARROW * ceiling:
        middle = low + (high - low) * CUT
        got = above(middle)
        low, high, inside = (middle, high, got) if got >= wanted else (low, middle, inside)
    out, open_ = [], [(low, top, inside)]
    while open_:
        a, b, count = open_.pop()
        if count <= few or b - a <= NARROW * ceiling:
            out += [(a, b, count)] if count else []
            continue
        middle = a + (b - a) * CUT
        upper = above(middle) - above(b)
        open_ += [(a, middle, count - upper), (middle, b, upper)]
    return sorted(out, reverse=True)


def feast(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of a symmetric matrix between low and high, falling, and their unit eigenvectors as columns."""
    n, center, radius = len(matrix), (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi * (places + 1) / 2  # over the upper half; the lower one is its mirror image
    scale = np.abs(matrix).sum(axis=1).max()
    random, size = np.random.default_rng(seed), min(n, 2 * count + 2)
    while True:
        basis = random.standard_normal((n, size))
        for _ in range(STEPS):
            filtered = np.zeros_like(basis)
            for angle, weight in zip(angles, weights):
                turn = np.exp(1j * angle)
                filtered += weight / 2 * (radius * turn * np.linalg.solve((center + radius * turn) * np.eye(n) - matrix, basis.astype(complex))).real
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz, on a matrix of ``size`` rows
            basis = basis @ turned
            inside = np.flatnonzero((values > low) & (values <= high))[::-1]
            rest = np.abs(matrix @ basis[:, inside] - basis[:, inside] * values[inside]).max(initial=0.0)
            if len(inside) == count and rest <= 4e-15 * n * scale:
                return values[inside], basis[:, inside]
        if len(inside) == count and rest <= 1e-11 * scale:
            return values[inside], basis[:, inside]
        if size == n:
            raise ArithmeticError(f"{len(inside)} eigenpairs between {low} and {high}, {count} by inertia")
        size = min(n, 2 * size)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, ``wanted`` at most and none that is nothing, and unit eigenvectors."""
    parts = [feast(matrix, *x) for x in intervals(matrix, wanted)]
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    vectors, _ = np.linalg.qr(np.concatenate([v for _, v in parts], axis=1))  # already orthogonal, but for rounding between intervals
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


@dataclass
class Model:
    """What whitens: n vectors with the sums S, eigenvalues (falling) and eigenvectors (columns) of their covariance."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows x, centred, on each component, over the root of its eigenvalue."""
        return (x - np.array(self.sums, np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sum over dimensions of (n * x - S) ** 2 of each row; OverflowError beyond 64 bits."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 2**63 else object
        return ((self.n * x.astype(kind) - np.array(self.sums, kind)) ** 2).sum(axis=1).astype(np.int64)


def scaled(vector: Column) -> Column:
    """Each entry c as the long floor(256 * c)."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of a matrix that ``of`` makes of the vectors of a batch; every task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_rows(batch.column(0), dims))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = rows.mapInArrow(tidied(run), f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r["i"] for r in sums), default=-1), 1 + max((r["j"] for r in sums), default=-1)), np.int64 if kind == "bigint" else np.float64)
    for r in sums:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = 4) -> Model:
    """A model over each distinct scaled vector once; rows that ``usable`` refuses take no part.

    Without any vector n is 0.  Components whose eigenvalue is nothing beside the largest are left out, so equal vectors, or
    one vector alone, give none.  Vectors of different lengths raise ValueError.
    """
    vector = F.col(f"`{vector_col}`")
    distinct = written(rows.where(usable(vector)).select(scaled(vector).alias("x")).distinct(), "vectors")
    size = distinct.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, dims = size["n"], size["most"] or 0
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} dimensions")
    if not n or not dims:
        return Model(n)
    sums = [int(s) for s in _summed(distinct, dims, lambda x: x.sum(axis=0, keepdims=True), "bigint")[0]]
    mean = np.array(sums, np.float64) / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(distinct, dims, products, "double") / n
    values, vectors = leading((covariance + covariance.T) / 2, components)
    model = Model(n, sums, values, vectors, float(np.trace(covariance)))
    if len(values):
        middle = _summed(distinct, dims, lambda x: model.whitened(x).sum(axis=0, keepdims=True), "double")[0] / n

        def check(x: np.ndarray) -> np.ndarray:
            y = model.whitened(x) - middle
            return y.T @ y

        model.identity_error = float(np.abs(_summed(distinct, dims, check, "double") / n - np.eye(len(values))).max())
    dropped(distinct)
    return model


def whiten(rows: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of rows and component.

    ``explained`` is the component's share of the covariance's trace.  Null and repeated ids stay as they are; without
    components there are no rows.
    """
    vector = F.col(f"`{vector_col}`")
    chosen = rows.where(usable(vector)).select(F.col(f"`{id_col}`").alias("c0"), scaled(vector).alias("c1"))
    dims, k = len(model.sums), len(model.values)
    out = T.StructType([T.StructField("id", rows.schema[id_col].dataType), *[T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    if not k:
        return rows.sparkSession.createDataFrame([], out)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _rows(batch.column(1), dims)
            numbers = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), np.repeat(model.deviations(x), k), model.whitened(x).ravel(), np.tile(explained, m), np.full(m * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), *map(pa.array, numbers)], names=out.names)

    return chosen.mapInArrow(tidied(run), out)
