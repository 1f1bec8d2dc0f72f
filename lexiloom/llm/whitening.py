"""Whitening of embeddings without a covariance matrix: principal directions from a tall-skinny QR.

Components are nearly integers, so sums are exact. Each task centres its rows by them and reduces its rows to a small
triangular factor R, batch after batch; factors are merged by further QR steps in a tree; the singular vectors of the last
R are the principal directions, its squared singular values their variances times the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialize

#: Factors that one task merges; the tree has so many branches.
FAN_IN = 8
#: Entries that are worked on at once, so that wide vectors take no more memory than narrow ones.
BLOCK = 1 << 19
_MOST = 2**62


def to_whole(vector: Column, scale: int = 1024, offset: int = 100_000) -> Column:
    """``floor(scale * c) + offset`` for each entry, as long. Entries beyond 2**52 are held at that, with their sign."""
    bound = float(2**52)
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c * scale))).cast("long") + F.lit(offset).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries only."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


@dataclass
class Whitening:
    """What :func:`fit` learns from rows of one length: ``sums`` over ``n`` rows, and directions as columns."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, each rounded once where n * x fits 64 bits."""
        if self._fits(x):
            return (x * np.int64(self.n) - np.array(self.sums, np.int64)) / self.n
        return x - np.array([float(Fraction(s, self.n)) for s in self.sums])

    def _fits(self, x: np.ndarray) -> bool:
        return not x.size or max(int(x.max()), -int(x.min()), 1) * self.n < _MOST and max(map(abs, self.sums)) < _MOST

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sums) ** 2``, exact; None where 64 bits don't hold it."""
        if self._fits(x):
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            if not d.size or max(int(d.max()), -int(d.min())) ** 2 * d.shape[1] < 2**63:
                return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on each direction, over its deviation; NaN on directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (self.centred(x) @ self.directions) * scale


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, each with its column of whole vectors as a matrix."""
    rows = max(1, BLOCK // dim)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, dim)


def exact_sums(points: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, as whole numbers of any size: a row per task and dimension is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b, x in _blocks(batches, 0, dim):
            n += b.num_rows
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dim, dtype=np.int32), "n": np.full(dim, n), "high": high, "low": low})

    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).cast("string").alias(c)
    rows = points.select("x").mapInArrow(add, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), whole("high"), whole("low"))
    got = sorted((r["dim"], r["n"], (int(r["high"]) << 32) + int(r["low"])) for r in rows.collect())  # a row per dimension
    return (got[0][1] if got else 0), [s for _, _, s in got]


def _triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def tsqr(points: DataFrame, dim: int, model: Whitening) -> np.ndarray:
    """R of all centred rows: a factor per task, then merged FAN_IN at a time until one is left."""
    schema = "r array<double>"
    as_row = lambda r: pa.RecordBatch.from_pydict({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for _, x in _blocks(batches, 0, dim):
            r = _triangle(np.vstack([r, model.centred(x)]))
        if len(r):
            yield as_row(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for b in batches:
            for i in range(b.num_rows):
                r = _triangle(np.vstack([r, b.column(0).slice(i, 1).flatten().to_numpy().reshape(-1, dim)]))
        if len(r):
            yield as_row(r)

    factors = materialize(points.select("x").mapInArrow(leaf, schema), "factors")
    left, tree = factors.count(), factors
    while left > 1:
        left = -(-left // FAN_IN)
        tree = tree.repartition(left).mapInArrow(merge, schema)
    r = np.array(tree.first()["r"]).reshape(-1, dim)
    discard(factors)
    return r


def fit(points: DataFrame, dim: int) -> Whitening | None:
    """Directions of ``points`` (a column ``x`` of whole vectors of ``dim`` entries); None if there are no rows."""
    n, sums = exact_sums(points, dim)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    r = tsqr(points, dim, model)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    basis = np.linalg.svd(r, full_matrices=True)[2] if len(vt) < dim else vt  # fewer rows than dimensions: the rest has no variance
    s[s <= (s[0] if len(s) else 0) * np.finfo(float).eps * max(n, dim)] = 0
    model.directions, model.eigenvalues, model.trace = basis.T, s * s / n, float((s * s).sum() / n)
    return model


def identity_error(points: DataFrame, dim: int, model: Whitening) -> float:
    """Largest entry, by size, of the covariance of all whitened rows less the identity, on directions with variance."""
    k = int((model.eigenvalues > 0).sum())
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, any_row = np.zeros(k), np.zeros((k, k)), False
        for _, x in _blocks(batches, 0, dim):
            w = model.whitened(x)[:, :k]
            first, second, any_row = first + w.sum(axis=0), second + w.T @ w, True
        if any_row:
            flat = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat), dtype=np.int32), "v": flat})

    rows = points.select("x").mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    flat = np.zeros(k * (k + 1))
    for r in rows:
        flat[r["at"]] = r["v"]
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: each vector on the ``k`` first components.

    Vectors are made whole first (:func:`to_whole`); all that are there and finite, repeats included, are fitted, and no
    sample. Null vectors and those with null or non-finite entries take no part; ids may be null or repeat; other
    columns are not looked at. Fewer dimensions than ``k`` give fewer components, vectors of no entries none. Vectors of
    each length, of which there are few, are fitted on their own. On a component without variance (equal vectors, more
    dimensions than vectors) ``whitened`` is null and ``explained`` 0. Equal eigenvalues leave the choice of directions
    open, but it is the same for all rows. ``deviation`` is null where a long doesn't hold it. An empty table gives an
    empty one. The driver sees the sums and one d x d factor, never rows.
    """
    rows = vectors.select(F.col(id_col).alias(id_col), F.col(vec_col).alias("v")).filter(usable(F.col("v"))).select(id_col, to_whole(F.col("v"), scale, offset).alias("x"))
    id_type = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for dim in sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect()):
        points = rows.filter(F.size("x") == dim)
        model = fit(points, dim) if dim else None
        if model is None:
            continue
        model.directions, model.eigenvalues = model.directions[:, :k], model.eigenvalues[:k]
        found = points.mapInArrow(_projector(model, dim, id_col, identity_error(points, dim, model)), schema)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _projector(model: Whitening, dim: int, id_col: str, error: float):  # noqa: ANN202
    k = len(model.eigenvalues)
    share = model.eigenvalues / model.trace if model.trace else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, 1, dim):
            m, w = b.num_rows, model.whitened(x).ravel()
            at = np.repeat(np.arange(m), k)
            columns = [
                b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(at)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project
