"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V of d dimensions is never formed. A pass over the rows takes a block Q
of columns and returns Xᵀ(XQ) of the centred rows, in partial sums by partition that are
added by row number. On the driver, that has matrices of d rows and a block's columns
only, Rayleigh-Ritz turns the block to the best eigenvectors within its span, residuals
|Vq - eq| say how far each is from true, and QR of the product makes the next block.
Iteration goes on until the residuals of all wanted components are within ``TOLERANCE``
of the largest eigenvalue. The block is twice as wide as the components asked for, and
wider again where ``PATIENCE`` passes don't suffice, so that eigenvalues that nearly
agree end in a block of the whole space, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, packed, table

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Largest absolute SCALE * c: below it all sums of a batch are exact as longs.
RANGE = 1 << 40
#: Largest residual of a component, as a part of the largest eigenvalue.
TOLERANCE = 1e-12
#: Passes after which the block is widened.
PATIENCE = 6
#: Eigenvalues below this part of the largest count as zero: there is nothing to scale.
RANK = 1e-10


class Whitening(NamedTuple):
    """What is fitted: rows, exact sums by dimension, components (columns) and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return means(self.sums, self.n)


def means(sums: list[int], n: int) -> np.ndarray:
    """S/n beyond OFFSET, rounded once."""
    return np.array([(s - OFFSET * n) / n for s in sums])


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, all entries finite and in RANGE."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * SCALE) >= F.lit(float(RANGE)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def entries(vectors: pa.Array) -> np.ndarray:
    """(rows, d) longs x - OFFSET of a list column of equal lengths."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(vectors), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = entries(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array(x.sum(axis=0))], ["i", "s"])


def _rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["i", "row"])


def _product(mean: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's share of Xᵀ(XQ), and below it that of the squares' sum."""
    out = np.zeros((len(mean) + 1, q.shape[1]))
    for b in batches:
        x = entries(b.column(0)) - mean
        out[:-1] += x.T @ (x @ q)
        out[-1, 0] += np.einsum("ij,ij->", x, x)
    yield _rows(out)


def _moments(mean: np.ndarray, scaled: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's share of the products of the whitened columns, and below it of their sums."""
    k = scaled.shape[1]
    out = np.zeros((k + 1, k))
    for b in batches:
        w = (entries(b.column(0)) - mean) @ scaled
        out[:-1] += w.T @ w
        out[-1] += w.sum(axis=0)
    yield _rows(out)


def _added(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Adds the partitions' matrices, row number by row number; the driver gets one."""
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((rows, columns))
    for r in sums.collect():
        out[r.i, r.j] = r.v
    return out


def fit(rows: DataFrame, vector: str, k: int) -> Whitening | None:
    """The first ``k`` components of the ``vector`` column, that holds usable vectors
    of one length; None where there is no row."""
    own = rows.select(vector)
    n = own.count()
    if not n:
        return None
    totals = own.mapInArrow(_sums, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    d = len(totals)
    sums = [int(r.s) + OFFSET * n for r in sorted(totals)]
    mean, k = means(sums, n), min(k, d)
    width, passes = min(d, 2 * k), 0
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))[0]
    while True:
        product = _added(own.mapInArrow(partial(_product, mean, q), "i int, row array<double>"), d + 1, width)
        passes += 1
        trace, product = product[-1, 0] / n, product[:-1] / n
        ritz = q.T @ product
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = q @ turn, product @ turn
        residuals = np.linalg.norm(images - vectors * values, axis=0)[:k]
        # a block of the whole space has no better one to come
        if width == d or residuals.max() <= TOLERANCE * max(values[0], 1e-300):
            break
        if passes % PATIENCE == 0:
            fresh = min(d, 2 * width) - width
            images = np.hstack([images, np.random.default_rng(passes).standard_normal((d, fresh))])
            width += fresh
        norms = np.linalg.norm(images, axis=0)
        q = np.linalg.qr(images / np.where(norms > 0, norms, 1))[0]
    vectors, values = vectors[:, :k], values[:k]
    real = values > RANK * max(values[0], 0)
    return Whitening(n, sums, vectors[:, real], values[real], trace, passes)


def identity_error(rows: DataFrame, vector: str, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""
    k = len(w.values)
    if not k:
        return 0.0
    found = _added(rows.select(vector).mapInArrow(partial(_moments, w.mean, w.components / np.sqrt(w.values)), "i int, row array<double>"), k + 1, k)
    mean = found[-1] / w.n
    return float(np.abs(found[:-1] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n*x-S)^2, exact; null beyond a long. ``x`` is less OFFSET."""
    shift = np.array([s - OFFSET * n for s in sums], object)
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, shift))
    if most * most * len(sums) < 1 << 62:
        return ((n * x - shift.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - shift) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def _whiten(w: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scaled = w.components / np.sqrt(w.values)
    for b in batches:
        if b.num_rows:
            x = entries(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviations(x, w.n, w.sums), pa.int64()), pa.array(list((x - w.mean) @ scaled), pa.list_(pa.float64()))], ["_row", "_deviation", "_whitened"]
            )


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most usable vectors have, of equally frequent ones the larger; 0 if there are none."""
    found = rows.where(usable(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def whiten(rows: DataFrame, vector: str = "embedding", k: int = 32, keep: list[str] | None = None) -> tuple[DataFrame, Whitening | None]:
    """(_row, _deviation, _whitened) of each row whose vector takes part, and what was
    fitted over all of these. ``_row`` has the ``keep`` columns (all if None), so no
    name can clash; ``_whitened`` has an entry for each component.

    Dropped: vectors that are null, empty, hold null or non-finite entries or entries of
    2^40/64 or more, and vectors of another length than most. Repeated rows count as
    often as they occur. Components whose eigenvalue is zero (within rounding) can't be
    scaled and are left out, so rows that are all equal have none; no rows give no rows.
    """
    arrow_batches(rows.sparkSession)
    d = usual_length(rows, vector)
    used = rows.where(usable(vector) & (F.size(vector) == d)).select(packed(rows.columns if keep is None else keep), F.col(vector).alias("_vector"))
    fitted = fit(used, "_vector", k) if d else None
    kind = used.schema["_row"].dataType.simpleString()
    out = f"_row {kind}, _deviation long, _whitened array<double>"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], out), None
    return used.mapInArrow(partial(_whiten, fitted), out), fitted


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out, w = whiten(rows, "embedding", 32, ["vec_id"])
    explained, error = [], 0.0
    if w is not None:
        explained = (w.values / w.trace).tolist() if w.trace else []
        used = rows.where(usable("embedding") & (F.size("embedding") == len(w.sums)))
        error = identity_error(used, "embedding", w)
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return out.select(F.col("_row.vec_id").alias("vec_id"), "_deviation", F.posexplode("_whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(w.n if w else 0).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"),
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
