"""Embedding whitening by TSQR: a tall matrix is reduced by QR factors only, its covariance is never formed.

A vector's entries c become whole numbers x = floor(SCALE * c) + SHIFT. The fit list is each distinct x vector
once. Its number of rows n and its sums S are exact, so rows are centred with one rounding, however far they lie from zero. Each task folds
its centred rows into a triangular factor R (QR of R on top of the next rows), the factors merge in a tree, again by QR, and the
singular value decomposition of the last R gives the components (right vectors) and, by their squares over n, the eigenvalues. Only
R, which is as wide and high as a vector is long, comes to the driver.

A row's whitened values are its centred vector on the components, over the roots of the eigenvalues. How white they are is measured in
another pass over the fit list: means and centred squares of each task's rows, merged like the factors.

Defined results: rows whose vector is null or has a null or non-finite entry are dropped; the fit and the result are of vectors of the commonest
length (of equals the longest), and vectors of other lengths are dropped, too, as they have no place in the same space; an entry beyond
BOUND counts as BOUND; repeated rows are all returned, and count once in the fit; null ids are returned as null; vectors of length 0 have no components and no rows; a component without variance (fewer
distinct rows than dimensions, a constant dimension) has null whitened values, an explained share of 0 (null if nothing
varies) and no part in the identity's error; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import materialize, named, release, ship
from quernstone.llm.vectors import merged, rows_of, usable, whole

SCALE, SHIFT = 64, 1_000_000
#: The largest entry, as a whole number: sums of 2^22 rows fit a long, tasks sum fewer at a time.
BOUND = 1 << 40
COMPONENTS = 16


class Fit(NamedTuple):
    """What rows are whitened with: n rows with the sums S, components as columns, and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles; the whole parts go first, so that nothing is lost to SHIFT."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - base).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum over the dimensions of (n x - S)^2, exact at any size."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        near = x - base
        top = int(np.abs(near).max(initial=0)) * self.n + self.n
        if top * top * max(1, x.shape[1]) < 1 << 62:
            d = near * self.n - np.array(rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        return [sum((v * self.n - r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.components / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x (longs, packed) and width of the rows whose vectors are usable. No shuffle."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sizes = {n for n in batch.column(1).value_lengths().to_pylist() if n}
            for width in sorted(sizes):
                keep, c = usable(batch.column(1), width)
                x = whole(c, SCALE, BOUND) + SHIFT
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), packed(x), pa.array([width] * len(keep), pa.int32())], names=["id", "x", "width"])

    return rows.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, x binary, width int")


def packed(x: np.ndarray) -> pa.Array:
    """A row of longs as bytes each."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<i8")], pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: a row a dimension comes to the driver."""

    dims = pa.array(np.arange(width, dtype=np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(width, np.int64)
        for batch in rows_of(batches):
            n, s = n + batch.num_rows, s + unpacked(batch.column(0), width).sum(axis=0)
            if n >= 1 << 20:
                yield pa.RecordBatch.from_arrays([dims, pa.array([n] * width, pa.int64()), pa.array(s)], names=["dim", "n", "s"])
                n, s = 0, np.zeros(width, np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([dims, pa.array([n] * width, pa.int64()), pa.array(s)], names=["dim", "n", "s"])

    by_dim = fit.select("x").mapInArrow(run, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = sorted(tuple(r) for r in by_dim.collect())
    return (got[0][1], [int(s) for _, _, s in got]) if got else (0, [])


def factor(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list."""
    centre = Fit(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in rows_of(batches):
            r = np.linalg.qr(np.vstack((r, centre.centred(unpacked(batch.column(0), width)))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_square(r).tobytes()], pa.binary())], names=["part", "state"])

    def _square(r: np.ndarray) -> np.ndarray:
        return np.vstack((r, np.zeros((width - len(r), width)))) if len(r) < width else r

    def merge(states: list[bytes]) -> bytes:
        return _square(np.linalg.qr(np.frombuffer(b"".join(states)).reshape(-1, width), mode="r")).tobytes()

    parts = materialize(fit.select("x").mapInArrow(run, "part long, state binary"), "r-factors")
    state = merged(parts, merge)
    release(parts)
    return np.frombuffer(state).reshape(width, width)


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    n, sums = totals(fit, width)
    if not n or not width:
        return Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    r = factor(fit, width, n, sums)
    _, s, right = np.linalg.svd(r / np.sqrt(n))
    values = s * s
    flat = s <= s[0] * max(n, width) ** 0.5 * np.finfo(float).eps * width
    return Fit(n, sums, right[:components].T.copy(), np.where(flat, 0.0, values)[:components], float(values.sum()))


def identity_error(fit: DataFrame, width: int, by: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    real = np.flatnonzero(by.values > 0)
    k = len(real)
    if not k:
        return 0.0

    def joined(a: tuple, b: tuple) -> tuple:
        """Rows, means and centred squares of both."""
        if not a[0]:
            return b
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple = (0.0, None, None)
        for batch in rows_of(batches):
            if batch.num_rows:
                w = by.whitened(unpacked(batch.column(0), width))[:, real]
                mean = w.mean(axis=0)
                state = joined(state, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        if state[0]:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([dumped(state)], pa.binary())], names=["part", "state"])

    def dumped(state: tuple) -> bytes:
        return np.concatenate(([state[0]], state[1], state[2].ravel())).tobytes()

    def loaded(data: bytes) -> tuple:
        a = np.frombuffer(data)
        return float(a[0]), a[1 : k + 1], a[k + 1 :].reshape(k, k)

    def merge(states: list[bytes]) -> bytes:
        out: tuple = (0.0, None, None)
        for s in states:
            out = joined(out, loaded(s))
        return dumped(out)

    parts = materialize(fit.select("x").mapInArrow(run, "part long, state binary"), "whitened-squares")
    n, _, squares = loaded(merged(parts, merge))
    release(parts)
    return float(np.abs(squares / n - np.eye(k)).max())


def commonest_width(vectors: DataFrame) -> int | None:
    top = vectors.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    return top and top[0]


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation (decimal), whitened, explained, identity_error: a row a usable vector and component."""
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = materialize(whole_vectors(rows, id_col, vec_col), "whole-vectors")
    width = commonest_width(vectors)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors.filter(F.col("width") == width)
    fit = materialize(vectors.select("x").distinct(), "fit-list")
    by = fitted(fit, width, components)
    error = identity_error(fit, width, by)
    release(fit)
    k = by.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            x = unpacked(batch.column(1), width)
            w = pa.array(np.ascontiguousarray(by.whitened(x)).ravel(), from_pandas=False)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), w)
            deviation = pa.array([str(d) for d in by.deviation(x)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, values], names=["id", "deviation", "w"])

    out = vectors.select("id", "x").mapInArrow(run, "id long, deviation string, w array<double>")
    shares = F.array(*[F.lit(float(v / by.trace) if by.trace else None).cast("double") for v in by.values])
    out = out.select("id", "deviation", F.posexplode("w").alias("at", "w"))
    return out.select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(by.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        F.when(F.element_at(F.array(*[F.lit(bool(v > 0)) for v in by.values]), F.col("at") + 1), F.col("w")).alias("whitened"),
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
