"""Forecasts that keep a correlation: the next value of a series, beside a curve whose
next value is known, is the one of a grid at which the correlation of both changes least.

The correlation of the longer series is (a*k + b) / sqrt(d * (n*k^2 + e*k + f)) in the next
value k, with coefficients that are sums over the series. So a wanted correlation is a
quadratic in k, and its roots lie next to the grid points at which the rounded correlation
comes within so many units of the old one. Only these are looked at, a few dozen of up to
16,500: no candidate is a row, and the result is that of the whole grid. They are arrays of
a batch of series, as expressions over an array a row take a hundred times as long.

A state is one row a series: its sums, its last value, and those of the curve. Values are in
whole units (``UNIT`` to one, ``FINE`` for the curve), so sums are exact in any order. A
forecast is appended by updating the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units to one of a series and of a curve, and candidates that are looked at at once.
UNIT, FINE, SEEN = 10_000, 1_000_000, 1 << 18


class Grid(NamedTuple):
    """Where and how the next value is searched for, all in units of the series: the window
    from the last value, the grid's step, places of the correlation, how many of its last
    place it may fall or rise (rising one less), and what one of these costs in units of
    distance. ``width`` is the most that a window spans."""

    low: Callable[[Column], Column]
    high: Callable[[Column], Column]
    width: int
    step: int
    places: int
    tolerance: int
    weight: int


#: FCS2: a third around the last value within [0, 1.7]; distance decides between equals only.
SECTOR = Grid(lambda x: F.greatest(x - 3000, F.lit(0.0)), lambda x: F.least(x + 3000, F.lit(17000.0)), 6000, 1, 3, 40, 1_000_000)
#: FCS3.
CATEGORY = Grid(lambda x: x - 3000, lambda x: x + 3000, 6000, 1, 4, 100, 10_000)
#: FCS4: from 8 below to 8.5 above, by thousandths.
BORROWER = Grid(lambda x: x - 80_000, lambda x: x + 85_000, 165_000, 10, 4, 100, 10_000)
#: FCS5: down to -3 from values up to 0, else 4 below; 0.3 above but not beyond 3.
AHEAD = Grid(lambda x: F.when(x <= 0, -30_000.0).otherwise(x - 40_000), lambda x: F.least(x + 3000, F.lit(30_000.0)), 73_000, 1, 3, 40, 10)


def units(c: str | Column, to_one: int = UNIT) -> Column:
    """A value in whole units, as a double."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * to_one + 0.5).cast("double")


def sums(x: Column, y: Column, pos: Column) -> list[Column]:
    """Aggregates that make a state of values in units; ``last`` and ``beside`` are of the newest place."""
    given = x.isNotNull() & y.isNotNull()
    one = lambda c: F.sum(F.when(given, c))
    return [
        one(F.lit(1.0)).alias("n"), one(x).alias("sx"), one(y).alias("sy"), one(x * x).alias("sxx"), one(y * y).alias("syy"), one(x * y).alias("sxy"),
        F.max_by(x, F.when(given, pos)).alias("last"), F.max_by(y, F.when(given, pos)).alias("beside"),
    ]


def _correlation(top: Column, dx: Column, dy: Column, grid: Grid) -> Column:
    """A correlation in units of its last place."""
    return F.when((dx > 0) & (dy > 0), F.floor(top / F.sqrt(dx * dy) * 10**grid.places + 0.5).cast("double"))


def _roots(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Both roots of p*k^2 + q*k + r without cancellation. What isn't a number does no harm:
    any number stands for the grid point next to it."""
    h = -(q + np.where(q < 0, -1.0, 1.0) * np.sqrt(np.maximum(q * q - 4 * p * r, 0.0))) / 2
    return [h / p, r / h]


def _found(step: int, places: int, tolerance: int, weight: int, levels: int, old, low, high, near, n, a, b, d, e, f, top) -> np.ndarray:
    """The best grid point of each series, NaN where there is none; arguments are columns (series, 1)."""

    def points(*reals: np.ndarray) -> np.ndarray:
        """Grid points about numbers."""
        i = (np.hstack(reals) - low) / step
        i = np.floor(np.minimum(np.maximum(np.where(np.isnan(i), 0.0, i), 0.0), top) + 0.5)
        return low + np.minimum(np.maximum(np.hstack([i - 1, i, i + 1]), 0.0), top) * step

    def change(k: np.ndarray) -> np.ndarray:
        dx = n * k * k + e * k + f
        return np.where((dx > 0) & (d > 0), np.floor((a * k + b) / np.sqrt(dx * d) * 10**places + 0.5), np.nan) - old

    def where(level: np.ndarray) -> list[np.ndarray]:
        """Numbers at which the correlation is one of ``level`` units."""
        w = level * level / float(10 ** (2 * places)) * d
        return _roots(a * a - w * n, 2 * a * b - w * e, b * b - w * f)

    # the least change is where the old correlation is met, at the turning point or at an end
    at = points(*where(old), (a * f - b * e / 2) / (b * n - a * e / 2), low, high, near)
    least = np.fmin.reduce(np.abs(change(at)), axis=1, keepdims=True)
    # further levels pay only as long as they cost less than all distance there is
    off = least + np.arange(levels + 1) + 0.5
    at = np.hstack([at, points(*where(np.hstack([old + off, old - off])))])
    moved, far = change(at), np.abs(at - near)
    cost = np.abs(moved) * weight + np.where(np.isnan(far), 0.0, far)
    cost = np.where((moved >= -tolerance) & (moved <= tolerance - 1), cost, np.inf)
    best = cost.min(axis=1, keepdims=True)
    return np.where(np.isinf(best[:, 0]), np.nan, np.where(cost == best, at, np.inf).min(axis=1))


def _searched(grid: tuple, batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    each = max(1, SEEN // (12 * grid[-1] + 30))
    for columns in batches:
        arrays = [c.to_numpy(np.float64)[:, None] for c in columns]
        with np.errstate(all="ignore"):
            parts = [_found(*grid, *(c[i : i + each] for c in arrays)) for i in range(0, len(arrays[0]), each)]
        yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))


def evenly(state: DataFrame) -> DataFrame:
    """States dealt to as many tasks as a shuffle has: a series is a small row that takes longer
    than its size says, so partitions that are joined by size are too few."""
    return state.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def next_value(state: DataFrame, next_y: str, grid: Grid, near: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """Adds ``forecast`` in units: of the grid's points whose rounded correlation is within
    the tolerance of the one so far, that with the least weighted change plus distance to
    ``near`` (the last value, if not given), of equals the smaller. Where none is within the
    tolerance it is ``fallback``; where there is no correlation (fewer than two places, a
    constant side, nulls) it is null."""
    c = {name: F.col(name) for name in ("n", "sx", "sy", "sxx", "syy", "sxy", "last")}
    y = F.col(next_y)
    n = c["n"]
    old = _correlation(n * c["sxy"] - c["sx"] * c["sy"], n * c["sxx"] - c["sx"] * c["sx"], n * c["syy"] - c["sy"] * c["sy"], grid)
    m, ty = n + 1, c["sy"] + y
    s = state.withColumns(
        {
            "_old": old, "_low": grid.low(c["last"]), "_high": grid.high(c["last"]), "_near": c["last"] if near is None else near,
            "_a": m * y - ty, "_b": m * c["sxy"] - c["sx"] * ty, "_d": m * (c["syy"] + y * y) - ty * ty, "_e": -2 * c["sx"], "_f": m * c["sxx"] - c["sx"] * c["sx"],
        }
    )
    # the last point is before the window's end
    s = s.withColumn("_top", F.ceil((F.col("_high") - F.col("_low")) / grid.step).cast("double") - 1)
    levels = min(grid.tolerance, ceil(grid.width / grid.weight) + 1)

    def searched(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from _searched((grid.step, grid.places, grid.tolerance, grid.weight, levels), batches)

    of = ("_old", "_low", "_high", "_near", "n", "_a", "_b", "_d", "_e", "_f", "_top")
    best = F.pandas_udf(searched, "double")(*(F.col(c).cast("double") for c in of))
    found = best if fallback is None else F.coalesce(best, fallback)
    s = s.withColumn("forecast", F.when(F.col("_old").isNotNull() & y.isNotNull() & (F.col("_top") >= 0), found))
    return s.drop("_old", "_low", "_high", "_near", "_a", "_b", "_d", "_e", "_f", "_top")


def rising(next_y: str, grid: Grid) -> Column:
    """FCS3's fallback: the window's end on the side to which the curve moves."""
    return F.when(F.col("beside") < F.col(next_y), grid.high(F.col("last"))).otherwise(grid.low(F.col("last")))


def appended(state: DataFrame, next_y: str) -> DataFrame:
    """The state with its forecast as a further place; a series without one stays as it is."""
    x, y, given = F.col("forecast"), F.col(next_y), F.col("forecast").isNotNull()
    grown = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    return state.withColumns({c: F.when(given, F.col(c) + v).otherwise(F.col(c)) for c, v in grown.items()} | {"last": F.coalesce(x, "last"), "beside": F.when(given, y).otherwise(F.col("beside"))})


def rolled(state: DataFrame, ahead: list[str], grid: Grid, near: Column | None = None, by_direction: bool = False) -> DataFrame:
    """FCS3, FCS5: adds a forecast for each of the columns ``ahead`` (the curve's next values,
    in order), named ``forecast_1`` and on; each is a place of the series for the next."""
    for i, y in enumerate(ahead, 1):
        state = next_value(state, y, grid, near, rising(y, grid) if by_direction else None)
        state = appended(state, y).withColumnRenamed("forecast", f"forecast_{i}")
    return state
