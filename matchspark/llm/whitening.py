"""Whitening of embeddings: projections on refined eigenvectors of a distributed covariance.

Entries become whole numbers, floor(256 c); equal vectors count once. Sums, the covariance (centred before
multiplying, one small matrix per task, added up in Spark) and the check of the whitened covariance are passes
over the distinct vectors; the driver only sees matrices as wide as a vector. ``eigenrefine`` gives the
eigenvectors. Distances to the mean stay whole numbers, n x - S, until the last division.

Vectors that are null or hold a null or a non-finite entry are left out; a shorter vector counts as filled up
with zeros to the longest. Entries beyond a long stop at its ends; a deviation of more than 38 digits is null. A
component without variance (below 1e-13 of the trace) can't be scaled to one and is left out, so one distinct
vector gives no rows, and neither does an empty table. Rows without id and repeated rows each give their rows;
other columns are not read. Equal eigenvalues give some orthonormal basis, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchspark.llm.common import materialize
from matchspark.llm.eigenrefine import eigen

STEPS = 256
#: Rows turned into a matrix at once: bounds the memory of a task.
BLOCK = 4096
FLAT = 1e-13
_LOW = (1 << 32) - 1


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part: x holds floor(256 c) of every entry c, as longs of one width."""
    v = F.col(vector_col).cast("array<double>")
    usable = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(v.isNotNull() & usable).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * STEPS)).alias("x"))
    short, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if short == width:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


@dataclass
class Whitening:
    """What the fit knows: ``n`` distinct vectors, their sums, and the components that have variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where their squares add up to a long, Python's integers elsewhere."""
        most = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if len(self.sums) * most * most < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def project(self, away: np.ndarray) -> np.ndarray:
        return (away / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def _added(fit: DataFrame, products) -> np.ndarray:
    """The sum over all tasks of the square matrices that ``products`` makes of blocks of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _blocks(batches, 0):
            total = total + products(x)
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    side = 1 + max((r["j"] for r in rows), default=-1)
    out = np.zeros((side, side))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sums per dimension): the upper and lower half of every long add up apart, so no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for _, x in _blocks(batches, 0):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & _LOW).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)],
                ["i", "n", "high", "low"])

    big = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(fit.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*big).collect())
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def fit(distinct: DataFrame, components: int = 4) -> Whitening:
    """The whitening of a table of distinct ``x`` as of ``whole_vectors``; at most ``components`` are kept."""
    n, sums = _sums(distinct)
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if n < 2:
        return model

    def centred(x: np.ndarray) -> np.ndarray:
        z = (model.from_mean(x) / n).astype(np.float64)
        return z.T @ z

    values, vectors = eigen(_added(distinct, centred) / n)
    trace = float(values.sum())
    keep = np.flatnonzero(values[:components] > FLAT * trace)
    model = Whitening(n, sums, values[keep], vectors[:, keep], trace)

    def whitened(x: np.ndarray) -> np.ndarray:
        w = model.project(model.from_mean(x))  # centred, as n x - S is
        return w.T @ w

    if len(keep):
        model.identity_error = float(np.abs(_added(distinct, whitened) / n - np.eye(len(keep))).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error) of every (id, x) and component."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            away = model.from_mean(x)
            squares = (away * away).sum(axis=1)
            if squares.dtype == object:
                squares = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
            else:
                squares = pa.array(squares).cast(pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            explained = np.tile(model.values / model.trace, len(x))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.n)), squares.take(at), pa.array(model.project(away).ravel()),
                pa.array(explained), pa.array(np.full(len(at), model.identity_error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return (rows if k else rows.limit(0)).mapInArrow(
        run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, *, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The columns of ``transform``, the id under its own name, of every row that takes part."""
    rows = whole_vectors(vectors, id_col, vector_col)
    model = fit(materialize(rows.select("x").distinct(), "vectors"), components)
    return transform(rows, model).withColumnRenamed("id", id_col)
