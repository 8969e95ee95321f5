"""Learning operators: SVD, NMF, k-means, pairwise ranking, topics, stems, DTW."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import kept
from . import blocks
from .factors import industry_topics, nmf  # noqa: F401


def svd(df: DataFrame, key: str, array: str, k: int) -> DataFrame:
    """VEC6 for dense vectors: coordinates on the k leading right singular vectors. The Gram
    matrix is summed in the executors (d x d, whatever the rows) and its eigenvectors are
    taken on the driver; wide sparse rows are for ``truncated_svd``. Signs are fixed so that
    each vector's largest entry is positive. Short and null vectors end in zeros."""
    sizes = blocks.widths(df, [array])
    vec = np.linalg.eigh(blocks.products(df, [array], sizes))[1][:, ::-1][:, :k]
    if vec.size:
        vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])])
    return blocks.coordinates(df, key, [array], sizes, vec).withColumnRenamed("projected", "svd")


def kmeans(df: DataFrame, key: str, array: str, k: int, seed: int = 7) -> DataFrame:
    """VEC15: the cluster of each vector."""
    v = df.where(F.col(array).isNotNull()).select(key, array_to_vector(F.col(array).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(v)
    return model.transform(v).select(key, F.col("prediction").alias("cluster"))


def ranknet(pairs: DataFrame, features: list[str], elastic: float = 0.0, strength: float = 1e-3) -> dict[str, float]:
    """RNK6: weights of a linear scorer from rows of feature differences (better minus
    worse): logistic regression without intercept on each row and its mirror."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    both = pairs.select(array_to_vector(x).alias("features"), F.lit(1.0).alias("label")).unionByName(pairs.select(array_to_vector(F.transform(x, lambda v: -v)).alias("features"), F.lit(0.0).alias("label")))
    model = LogisticRegression(fitIntercept=False, regParam=strength, elasticNetParam=elastic, maxIter=50).fit(both)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True))


def importance(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """RNK8: weight times the standard deviation of each feature's difference."""
    return pairs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.lit(w).alias("w")) for f, w in weights.items()))).alias("r")).groupBy("r.feature").agg(F.round(F.max("r.w") * F.stddev_pop("r.x"), 6).alias("importance"))


#: Different rows of a level that meet in one piece of a task's work.
TILE = 2048


def _levels(lists: DataFrame, keys: list[str], rel: str, features: list[str], tile: int) -> DataFrame:
    """Pieces of levels of relevance that meet: of each list every piece of a higher level
    with every piece of a lower one. Rows of equal features are one with their number."""
    x = [F.col(f).cast("double").alias(f) for f in features]
    rows = lists.select(*keys, F.col(rel).alias("_r"), *x).na.drop(subset=features).groupBy(*keys, "_r", *features).agg(F.count("*").cast("double").alias("_n"))
    # pieces by hash, as many as the level needs
    sizes = rows.groupBy(*keys, "_r").agg(F.ceil(F.count("*") / tile).alias("_pieces"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_r")]
    placed = rows.alias("l").join(F.broadcast(sizes).alias("r"), same).select("l.*", F.pmod(F.xxhash64(*features), F.col("_pieces")).alias("_piece"))
    pieces = placed.groupBy(*keys, "_r", "_piece").agg(F.collect_list(F.array("_n", *features)).alias("rows"))
    pieces = kept(pieces, "levels")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return pieces.alias("a").join(pieces.alias("b"), [*on, F.col("a._r") > F.col("b._r")]).select(F.col("a.rows").alias("better"), F.col("b.rows").alias("worse"))


def _summed_pairs(w: np.ndarray | None, scale: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without weights the number of pairs and the sums of differences and of their squares;
    with them loss, gradient and second derivatives."""
    k = len(scale)
    out = np.zeros(1 + 2 * k if w is None else 1 + k + k * k)
    for b in batches:
        for better, worse in zip(b.column(0), b.column(1), strict=True):
            (n, x), (m, y) = ((a[:, 0], a[:, 1:] / scale) for a in (s.values.flatten().to_numpy().reshape(-1, k + 1) for s in (better, worse)))
            for at in range(0, len(n), 256):
                d, c = x[at : at + 256, None] - y[None], n[at : at + 256, None] * m[None]
                if w is None:
                    out += np.concatenate([[c.sum()], (c[..., None] * d).sum((0, 1)), (c[..., None] * d * d).sum((0, 1))])
                    continue
                z = d @ w
                p = 1 / (1 + np.exp(np.minimum(z, 700)))
                curve = c * p * (1 - p)
                out += np.concatenate([[(c * np.logaddexp(0, -z)).sum()], -((c * p)[..., None] * d).sum((0, 1)), np.einsum("ij,ijk,ijl->kl", curve, d, d).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])


def ranknet_lists(lists: DataFrame, keys: list[str], rel: str, features: list[str], strength: float = 1e-3) -> tuple[dict[str, float], dict[str, float]]:
    """RNK6, RNK8: what ``ranknet`` and ``importance`` give for the preferences of lists,
    without making the pairs: weights by Newton's method, whose sums over pairs are made
    where two pieces of levels meet, and each feature's importance."""
    pieces = _levels(lists, keys, rel, features, TILE)
    tiles = kept(pieces.repartition(4 * pieces.sparkSession.sparkContext.defaultParallelism), "tiles")

    def summed(w: np.ndarray | None, scale: np.ndarray) -> np.ndarray:
        found = tiles.mapInArrow(partial(_summed_pairs, w, scale), "sums array<double>").collect()
        return np.sum([r.sums for r in found], axis=0) if found else np.zeros(1)

    k = len(features)
    first = summed(None, np.ones(k))
    n = first[0]
    if not n:
        raise ValueError("no preferences")
    mean, square = first[1 : 1 + k] / n, first[1 + k :] / n
    # each pair and its mirror have mean zero; the penalty is on standardised weights, as in Spark's
    scale = np.sqrt(square * 2 * n / (2 * n - 1))
    scale = np.where(scale > 0, scale, 1.0)
    w = np.zeros(k)
    for _ in range(50):
        s = summed(w, scale) / n
        step = np.linalg.solve(s[1 + k :].reshape(k, k) + strength * np.eye(k), s[1 : 1 + k] + strength * w)
        w = w - step
        if np.abs(step).max() <= 1e-10 * max(1.0, np.abs(w).max()):
            break
    weights = w / scale
    return dict(zip(features, weights.tolist(), strict=True)), dict(zip(features, (weights * np.sqrt(np.maximum(square - mean**2, 0))).tolist(), strict=True))


def _dtw(a: np.ndarray, b: np.ndarray, window: int) -> float:
    return float(_dtw_rows(a[None], b[None], window)[0])


def _dtw_rows(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Distances of rows of two matrices, (rows, n) and (rows, m): the band's cells by
    anti-diagonals, of which each needs the two before it, for all rows at once."""
    n, m = a.shape[1], b.shape[1]
    if not n or not m:
        return np.full(len(a), np.nan)
    window = max(window, abs(n - m))
    # cost[i] of the cells (i, s - i), with a row and a column of infinity before the first
    older = np.full((len(a), n + 1), np.inf)
    old = np.full((len(a), n + 1), np.inf)
    older[:, 0] = 0
    for s in range(2, n + m + 1):
        low, high = max(1, s - m, -(-(s - window) // 2)), min(n, s - 1, (s + window) // 2)
        new = np.full((len(a), n + 1), np.inf)
        if low <= high:
            i = np.arange(low, high + 1)
            best = np.minimum(np.minimum(old[:, i - 1], old[:, i]), older[:, i - 1])
            new[:, i] = np.abs(a[:, i - 1] - b[:, s - i - 1]) + best
        older, old = old, new
    return old[:, n]


def dtw(a: Column, b: Column, window: int) -> Column:
    """VEC21: dynamic time warping distance of arrays in a band; null where a side is
    null or empty. Pairs of the same two lengths are worked out together."""

    @F.pandas_udf(T.DoubleType())
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        given = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p is not None and q is not None]
        groups: dict[tuple[int, int], list[int]] = {}
        for i in given:
            groups.setdefault((len(x.iloc[i]), len(y.iloc[i])), []).append(i)
        for (n, m), own in groups.items():
            out[own] = _dtw_rows(np.array([x.iloc[i] for i in own], float).reshape(len(own), n), np.array([y.iloc[i] for i in own], float).reshape(len(own), m), window)
        return pd.Series(out)

    return each(a, b)


def one_hot(c: Column, categories: list[str]) -> Column:
    """VEC8, VEC10: 1.0 at the category's place; all zero for others and null."""
    return F.array(*(F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in categories))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """VEC9: columns less their mean over their sample deviation, as one array."""
    stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))))
    return df.join(F.broadcast(stats)).withColumn("features", F.array(*(F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)), 6) for c in columns))).drop(*(f"_{x}_{c}" for c in columns for x in "ms"))


def sparse_parts(vector: Column, size: int) -> Column:
    """VEC11: (size, indices, values) of the non-zero entries of a vector column."""
    a = vector_to_array(vector)
    at = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(a, i) != 0)
    return F.struct(F.lit(size).alias("size"), at.alias("indices"), F.transform(at, lambda i: F.get(a, i)).alias("values"))
