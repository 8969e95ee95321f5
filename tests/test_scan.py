import random

import pytest
from pyspark.sql import functions as F

from quaylight.operators import scan


def some_rows(n=3000):
    """A key with most rows, small ones, a null key, ties, null values and repeated rows."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.choice([None, *range(40)]) if i % 3 else rng.randrange(10**6), rng.randrange(-3, 4), i) for i in range(n)]
    return [*rows, ("one", 5, 1, n), ("only nulls", None, 2, n + 1)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ranks_and_sums(spark, parts):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k string, v long, w long, id long").repartition(5)
    got = {r.id: (r["rank"], r.total) for r in scan.scanned(df, ["k"], [F.col("v"), -F.col("id")], "rank", {"total": F.col("w")}, parts).collect()}
    want, by = {}, {}
    for k, v, w, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[3])):
        n, total = by.get(k, (0, 0))
        by[k] = want[i] = (n + 1, total + w)
    assert got == want


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, word string")
    assert {(r.id, r["rank"]) for r in scan.scanned(df, [], [F.col("word")], "rank", parts=2).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert scan.scanned(df.where("id < 0"), ["id"], [F.col("word")], "rank").count() == 0
    assert scan.quantiles(df.where("id < 0"), ["word"], "id", [0.5]).count() == 0


@pytest.mark.parametrize("parts", [1, 9, 64])
def test_values_at_ranks_and_quantiles(spark, parts):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k string, v long, w long, id long").repartition(5)
    by = {}
    for k, v, _, _ in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    ranks = lambda n: F.array(F.lit(0).cast("long"), n - 1, F.floor(n / 2), n + 5)
    got = {(r.k, r["rank"]): (r.v, r.n) for r in scan.at_ranks(df, ["k"], "v", ranks, parts).collect()}
    assert got == {(k, i): (sorted(v)[i], len(v)) for k, v in by.items() for i in {0, len(v) - 1, len(v) // 2}}
    at = [0.0, 0.05, 0.5, 0.99, 1.0]
    found = {(r.k, r.q): r.v for r in scan.quantiles(df, ["k"], "v", at, parts).collect()}
    for k, v in by.items():
        v = sorted(v)
        for q in at:
            low = int((len(v) - 1) * q)
            high = min(low + 1, len(v) - 1)
            assert found[k, q] == pytest.approx(v[low] + (v[high] - v[low]) * ((len(v) - 1) * q - low))
    assert len(found) == len(by) * len(at)


def test_a_frequent_key_is_cut_and_parts_are_even(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("rare").alias("k"), (F.col("id") * 7919 % 20000).alias("v"))
    sizes = [r["count"] for r in scan.dealt(df, ["k"], [F.col("v")], 20).groupBy("_k", "_part").count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 4000
