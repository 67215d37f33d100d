"""Embedding whitening by a two-pass covariance.

Entries become integers (x). The first pass sums the distinct x vectors exactly; the second sums the outer products of
the centred vectors, a matrix product for each Arrow batch, and treeAggregate merges the tasks' matrices, of d * d
doubles each. The driver takes the eigenvectors of one d * d matrix (LAPACK, symmetric) and broadcasts the projection.
A third pass measures the covariance of what comes out.

Centring is exact: with S = q * n + r, x - S / n is the integer x - q less r / n, so large means cost no digits.

Edge cases: rows are dropped whose vector is null, empty, or holds a null, NaN, infinite or too large entry (2^56 and
beyond don't fit a long after scaling), or whose length isn't the most frequent one (of several, the longest). Rows that
share an id, and those without one, are each projected. A component without variance, up to rounding, can't be scaled to
one and is left out, so a single distinct vector gives no rows, as does an empty table. A deviation beyond a long
is null in the query, while `whiten` gives it as a decimal. Other columns stay out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Beyond this, int64 products may overflow and Python's integers are used.
SAFE = 1 << 62


def usable(v: Column) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(entry(c.cast("double")), F.lit(False)))


def integers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def integer_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id and x, an array of longs of the one length, of each row that stays."""
    rows = vectors.filter(usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(vector)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column) -> np.ndarray:
    """The vectors of a batch as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums(fit: DataFrame) -> list[int]:
    """The exact sum of each dimension: halves of the numbers add up without overflow in a batch, decimals across batches."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array((x >> 31).sum(0)), pa.array((x & 0x7FFFFFFF).sum(0))], names=["dim", "high", "low"])

    halves = fit.select("x").mapInArrow(run, "dim long, high long, low long").groupBy("dim")
    rows = halves.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()  # a row for each dimension
    return [(int(r["high"]) << 31) + int(r["low"]) for r in sorted(rows, key=lambda r: r["dim"])]


@dataclass
class Mean:
    """S / n of each dimension, as q + r / n in integers."""

    n: int
    total: list[int]

    def __post_init__(self):
        self.q, self.r = zip(*(divmod(s, self.n) for s in self.total)) if self.total else ((), ())

    def _exact(self, x: np.ndarray) -> np.ndarray:
        q = np.array(self.q, object)
        few = not x.size or max(int(np.abs(x).max()), max(map(abs, self.q))) < SAFE
        return x - q.astype(np.int64) if few else x.astype(object) - q

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self._exact(x).astype(np.float64) - np.array([r / self.n for r in self.r])

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - S) ** 2 over the dimensions."""
        y = self._exact(x)
        if not y.size:
            return [0] * len(y)
        most = (int(np.abs(y).max()) + 1) * self.n
        if most * most * y.shape[1] < SAFE:
            away = y * self.n - np.array(self.r, np.int64)
            return (away * away).sum(1).tolist()
        away = y.astype(object) * self.n - np.array(self.r, object)
        return [int(v) for v in (away * away).sum(1)]


def outer_sum(rows: DataFrame, column: str, vectors, d: int) -> np.ndarray:
    """The sum of the outer products of vectors(batch matrix), a matrix product for each batch, merged as a tree."""

    def run(batches):
        one_thread()
        own = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                y = vectors(_matrix(batch.column(column)))
                own += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["m"])

    parts = rows.select(column).mapInArrow(run, "m binary").rdd
    return parts.treeAggregate(np.zeros((d, d)), lambda a, r: a + np.frombuffer(bytes(r["m"])).reshape(d, d), lambda a, b: a + b)


@dataclass
class Whitening:
    mean: Mean
    values: np.ndarray  # eigenvalues, falling
    projection: np.ndarray  # d x k: eigenvectors over the roots of their values
    explained: np.ndarray
    identity_error: float = 0.0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x of rows; None where there are none."""
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "fit-list")
    n = distinct.count()
    if not n:
        return None
    mean = Mean(n, sums(distinct))
    d = len(mean.total)
    v = outer_sum(distinct, "x", mean.centred, d) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(v))
    k = int(((values > trace * d * np.finfo(float).eps) & (np.arange(d) < components)).sum())
    axes = axes[:, :k] * np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)[:k]
    own = Whitening(mean, values[:k], axes / np.sqrt(values[:k]), values[:k] / trace if k else values[:0])
    if k:
        after = outer_sum(distinct, "x", lambda x: mean.centred(x) @ own.projection, k) / n
        own.identity_error = float(np.abs(after - np.eye(k)).max())
    return own


def whiten(rows: DataFrame, own: Whitening) -> DataFrame:
    """vec_id, n, deviation and the whitened vector of each of rows."""
    shared = rows.sparkSession.sparkContext.broadcast((own.mean, own.projection))  # d * k numbers

    def run(batches):
        one_thread()
        mean, projection = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                out = mean.centred(x) @ projection
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
                # beyond 38 digits no decimal holds it
                far = [str(v) if v < 10**38 else None for v in mean.deviation(x)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(far, pa.string()), flat], names=["vec_id", "deviation", "whitened"])

    out = rows.mapInArrow(run, "vec_id long, deviation string, whitened array<double>")
    return out.select("vec_id", F.lit(own.mean.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def query(spark: SparkSession, vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    rows = integer_rows(vectors, vector)
    own = fit(rows, components)
    if own is None or not len(own.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
    each = whiten(rows, own).select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    of = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("place") + 1)
    component = (F.col("place") + 1).cast("int").alias("component")
    return each.select("vec_id", component, "n", "deviation", "whitened", of(own.explained).alias("explained"), F.lit(own.identity_error).alias("identity_error"), of(own.values).alias("eigenvalue"))
