import math
import random

import pytest
from pyspark.sql import functions as F

from quaylight.operators import forecast as FC

WINDOWS = {
    "SECTOR": lambda x: (max(x - 3000, 0), min(x + 3000, 17000)),
    "CATEGORY": lambda x: (x - 3000, x + 3000),
    "BORROWER": lambda x: (x - 80000, x + 85000),
    "AHEAD": lambda x: (-30000 if x <= 0 else x - 40000, min(x + 3000, 30000)),
}


def correlation(x, y, places):
    n, sx, sy = len(x), sum(x), sum(y)
    dx, dy = n * sum(v * v for v in x) - sx * sx, n * sum(v * v for v in y) - sy * sy
    top = n * sum(a * b for a, b in zip(x, y, strict=True)) - sx * sy
    return math.floor(top / math.sqrt(float(dx) * float(dy)) * 10**places + 0.5) if dx > 0 and dy > 0 else None


def whole_grid(x, y, ny, name, near=None, fallback=None):
    """The next value by looking at every candidate."""
    grid, (low, high) = getattr(FC, name), WINDOWS[name](x[-1])
    old = correlation(x, y, grid.places)
    if old is None or high <= low:
        return None
    best = None
    for i in range(math.ceil((high - low) / grid.step)):
        k = low + i * grid.step
        new = correlation([*x, k], [*y, ny], grid.places)
        if new is not None and -grid.tolerance <= new - old < grid.tolerance:
            cost = (abs(new - old) * grid.weight + abs(k - (x[-1] if near is None else near)), k)
            best = cost if best is None else min(best, cost)
    return fallback(y[-1], ny, low, high) if best is None and fallback else best and best[1]


def some_series(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        places = rng.choice([3, 3, 4, 5, 8])
        y = [rng.randrange(-300_000, 300_000) for _ in range(places)]
        kind = i % 5
        x = [10 * rng.randrange(-1000, 1000) if kind < 3 else round(v / 100) + rng.randrange(-20, 20) if kind == 3 else -round(v / 60) for v in y]
        x = [500] * places if i == 7 else x
        out.append((i, x, y, rng.randrange(-400_000, 400_000)))
    return out


def states(spark, rows):
    flat = [(i, p, float(a), float(b), float(ny)) for i, x, y, ny in rows for p, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(flat, "i int, p int, x double, y double, ny double")
    return df.groupBy("i").agg(*FC.sums(F.col("x"), F.col("y"), F.col("p")), F.max("ny").alias("ny"), (F.max("ny") * 2 - 5).alias("after"))


@pytest.mark.parametrize("name", list(WINDOWS))
def test_equals_the_whole_grid(spark, name):
    rows = some_series(12 if name in ("BORROWER", "AHEAD") else 25, name)
    got = {r.i: r.forecast for r in FC.next_value(states(spark, rows), "ny", getattr(FC, name)).collect()}
    assert got == {i: whole_grid(x, y, ny, name) for i, x, y, ny in rows}
    assert sum(v is not None for v in got.values()) >= len(rows) / 4 or name == "SECTOR"


def test_rolls_with_nearness_and_fallback(spark):
    rows = some_series(15, "roll")
    found = FC.rolled(states(spark, rows), ["ny", "after"], FC.CATEGORY, near=F.lit(700.0), by_direction=True).collect()
    fallback = lambda y, ny, low, high: high if y < ny else low
    fell = 0
    for r in found:
        _, x, y, ny = rows[r.i]
        x, y = list(x), list(y)
        for nxt, got in ((ny, r.forecast_1), (2 * ny - 5, r.forecast_2)):
            want = whole_grid(x, y, nxt, "CATEGORY", 700, fallback)
            assert got == want
            fell += want is not None and whole_grid(x, y, nxt, "CATEGORY", 700) is None
            if want is not None:
                x.append(int(want))
                y.append(nxt)
    assert fell


def test_no_correlation_no_forecast(spark):
    rows = [(0, 0, 1.0, 2.0), (1, 0, 5.0, 1.0), (1, 1, 5.0, 2.0), (1, 2, 5.0, 3.0), (2, 0, 1.0, 4.0), (2, 1, 2.0, 4.0), (3, 0, None, None), (4, 0, 1.0, 1.0), (4, 1, 2.0, 2.0), (4, 2, None, 3.0)]
    s = spark.createDataFrame(rows, "i int, p int, x double, y double").groupBy("i").agg(*FC.sums(F.col("x"), F.col("y"), F.col("p")))
    got = {r.i: r.forecast for r in FC.next_value(s.withColumn("ny", F.lit(3.0)), "ny", FC.CATEGORY).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 3.0}
    assert FC.next_value(s.where("i = 4").withColumn("ny", F.lit(None).cast("double")), "ny", FC.CATEGORY).first().forecast is None
    assert FC.next_value(s.where("i < 0").withColumn("ny", F.lit(3.0)), "ny", FC.CATEGORY).count() == 0


def test_units_are_to_the_nearest(spark):
    df = spark.createDataFrame([(0.1,), (-0.00005,), (0.12345,), (None,)], "v double")
    assert [r.u for r in df.select(FC.units("v").alias("u")).collect()] == [1000.0, 0.0, 1235.0, None]


def test_a_batch_takes_microseconds_a_series(spark):
    """Candidates are arrays of a batch: an expression over an array a row takes a millisecond."""
    import time

    series = states(spark, some_series(20, "fast")).crossJoin(spark.range(0, 2000, 1, 4).select(F.col("id").alias("copy"))).repartition(4).cache()
    series.count()
    for _ in range(2):
        begin = time.time()
        found = FC.next_value(series, "ny", FC.AHEAD).groupBy("i").agg(F.count("forecast").alias("n"), F.count_distinct("forecast").alias("kinds")).collect()
        took = time.time() - begin
    series.unpersist()
    assert all((r.n, r.kinds) in ((0, 0), (2000, 1)) for r in found) and any(r.n for r in found)
    assert took < 6
