"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """PRJ5: a / b, null for a zero divisor."""
    return F.try_divide(a, b)


def magnitude(c: Column) -> Column:
    """MTH5: multiplier of b, m, mn, k; 1 without one."""
    return F.when(F.lower(c) == "b", 1e9).when(F.lower(c).isin("m", "mn"), 1e6).when(F.lower(c) == "k", 1e3).otherwise(1.0)


def symmetric_ratio(a: Column, b: Column) -> Column:
    """MTH6: lesser over greater, 0 for null or zero."""
    return F.when(a.isNull() | b.isNull() | (a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def band(c: Column) -> Column:
    """MTH9: piece-wise money scale in half-open bands; each band is a tenth of [0, 1]."""
    edges = [1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9, 1e10]
    out, low = F.when(c < 0, 0.0), 0.0
    for i, high in enumerate(edges):
        out = out.when(c < high, (c - low) / (high - low) * 0.1 + i * 0.1)
        low = high
    return out.otherwise(F.when(c.isNotNull(), 1.0))


def nde_scale(c: Column) -> Column:
    """MTH10: 1 - x in [0, 1], else 0."""
    return F.when(c.between(0, 1), 1 - c).otherwise(0.0)


def tde_scale(c: Column) -> Column:
    """MTH10: (100 - x) / 100 in [0, 100], else 0."""
    return F.when(c.between(0, 100), (100 - c) / 100).otherwise(0.0)


def log_window(p: Column, b: Column, w: float) -> Column:
    """RNK2: same sign and within a factor 10^w, strictly; 0 for nulls."""
    k = 10.0**w
    near = (F.sign(p) == F.sign(b)) & (F.abs(p) > F.abs(b) / k) & (F.abs(p) < F.abs(b) * k)
    return F.coalesce(near.cast("double"), F.lit(0.0))


def quantise(c: Column, points: list[float]) -> Column:
    """VEC13: bucket in the symmetric points ±q, 0: how many are <= the value, plus
    2; 1 for null, so that 0 is left for padding."""
    every = sorted({-q for q in points} | {0.0} | set(points))
    return F.when(c.isNull(), 1).otherwise(sum((c >= p).cast("int") for p in every) + 2)


def dequantise(c: Column, points: list[float]) -> Column:
    """VEC14: the range of a bucket as text."""
    every = sorted({-q for q in points} | {0.0} | set(points))
    edges = F.array(*(F.lit(float(x)) for x in [float("-inf"), *every, float("inf")]))
    return F.when(c >= 2, F.format_string("%.4f - %.4f", F.get(edges, c - 2), F.get(edges, c - 1)))


def bucket(c: Column, splits: list[float]) -> Column:
    """VEC12: index of the half-open range between fixed splits; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(splits, splits[1:], strict=False)):
        hit = (c >= a) & (c < b)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def arithmetic_hash(c: Column, seed: int = 0) -> Column:
    """SMP1, SMP6: a reproducible number below 2^32 from an integer key."""
    return F.pmod((c + seed) * F.lit(2654435761), F.lit(4294967296))


def dot(a: Column, b: Column) -> Column:
    """VEC1: inner product of arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """VEC3: squared distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """VEC5: cosine; null with a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
