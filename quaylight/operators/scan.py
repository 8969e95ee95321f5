"""Ranks, running sums and exact quantiles within keys that may hold any share of the rows.

A window over a key takes all its rows to one task. Here rows are dealt by ranges of (key,
order): a sample gives the cuts, a frequent key is cut into many parts and rare ones share
one. Parts are scanned by themselves and begin where the sums of the parts before them end.
For a value at a rank only the parts that hold wanted ranks are sorted at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.io import kept

#: Parts at most (cuts become an expression), and rows of the sample for each.
PARTS, EACH = 256, 100


def _cuts(df: DataFrame, parts: int) -> list:
    """Up to ``parts - 1`` places between which rows are about equally many."""
    n = df.count()
    want = parts * EACH
    some = (df if n <= want else df.sample(want / n, 0)).select("_place").collect()
    # nulls first, as Spark orders them
    flat = sorted({tuple(r._place) for r in some}, key=lambda t: tuple((v is not None, v) if not isinstance(v, tuple) else tuple((x is not None, x) for x in v) for v in t))
    return [flat[i * len(flat) // parts] for i in range(1, parts)] if len(flat) >= parts else flat


def dealt(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``df``, stored, with its key ``_k``, its place ``_at`` in the ascending order and the
    number ``_part`` of the range that it is in; ranges of a key are numbered in order."""
    spark = df.sparkSession
    parts = min(PARTS, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = df.withColumns({"_k": F.struct(*keys) if keys else F.struct(F.lit(0)), "_at": F.struct(*(c.alias(f"c{i}") for i, c in enumerate(order)))})
    own = kept(own.withColumn("_place", F.struct("_k", "_at")), "scan")
    kind = own.schema["_place"].dataType.simpleString()
    cuts = [F.struct(*(F.struct(*map(F.lit, half)) for half in c)).cast(kind) for c in _cuts(own, parts)]

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_place") <= cuts[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return own.withColumn("_part", within(0, len(cuts))).drop("_place")


def _starts(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_k, _part) with the rows (``_n``) and sums in the key's parts before it, one row a part."""
    totals = rows.groupBy("_k", "_part").agg(F.count("*").alias("_own"), *(F.sum(c).alias(f"_own_{s}") for s, c in sums.items()))
    before = W.Window.partitionBy("_k").orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    so_far = lambda c, name: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name)
    return totals.select("_k", "_part", "_own", so_far("_own", "_n"), *(so_far(f"_own_{s}", f"_before_{s}") for s in sums))


def scanned(df: DataFrame, keys: list[str], order: list[Column], rank: str, sums: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """WIN3-6, AGG23: adds the 1-based rank of each row in its key by the ascending ``order``,
    and sums of the rows up to it. Rows of one place are in any order among themselves; null
    keys are a key and null places come first; no rows give no rows."""
    rows = dealt(df, keys, order, parts)
    for s, c in (sums or {}).items():
        rows = rows.withColumn(f"_of_{s}", c)
    own = W.Window.partitionBy("_k", "_part").orderBy("_at")
    here = own.rowsBetween(W.Window.unboundedPreceding, 0)
    names = list(sums or {})
    starts = _starts(rows, {s: F.col(f"_of_{s}") for s in names}).drop("_own")
    rows = rows.withColumns({"_rank": F.row_number().over(own)} | {f"_sum_{s}": F.sum(f"_of_{s}").over(here) for s in names})
    out = rows.join(starts, ["_k", "_part"])
    found = {rank: (F.col("_rank") + F.col("_n")).cast("long")} | {s: F.col(f"_sum_{s}") + F.col(f"_before_{s}") for s in names}
    return out.withColumns(found).select(*df.columns, *found)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column], parts: int | None = None) -> DataFrame:
    """AGG29, AGG30: (keys, rank, value, n) at 0-based ranks of the ascending values of each
    key. ``ranks`` gives an array of them from the number of the key's rows; null values are
    left out. Parts are the bins of a histogram: their counts say which hold wanted ranks, and
    only rows of these are ordered."""
    rows = dealt(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [F.col(value)], parts)
    starts = _starts(rows, {})
    ends = starts.withColumn("_all", F.sum("_own").over(W.Window.partitionBy("_k")))
    inside = F.filter(F.array_distinct(ranks(F.col("_all"))), lambda r: (r >= F.col("_n")) & (r < F.col("_n") + F.col("_own")))
    wanted = ends.select("_k", "_part", "_n", "_all", F.explode(inside).alias("rank")).select("_k", "_part", (F.col("rank") - F.col("_n") + 1).alias("_rank"), "rank", F.col("_all").alias("n"))
    hit = rows.join(wanted.select("_k", "_part").distinct(), ["_k", "_part"], "left_semi")
    hit = hit.withColumn("_rank", F.row_number().over(W.Window.partitionBy("_k", "_part").orderBy("_at")).cast("long"))
    return hit.join(wanted, ["_k", "_part", "_rank"]).select(*keys, "rank", value, "n")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], parts: int | None = None) -> DataFrame:
    """AGG30: (keys, q, value) by linear interpolation between the two nearest ranks."""
    low = lambda n, q: F.floor((n - 1) * q)
    both = lambda n: F.flatten(F.array(*(F.array(low(n, q), F.least(low(n, q) + 1, n - 1)) for q in at)))
    found = at_ranks(df, keys, value, both, parts)
    # of each key a few values
    held = found.groupBy(*keys).agg(F.max("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_v"))
    n, v = F.col("_n"), F.col("_v")
    each = [F.struct(F.lit(q).alias("q"), (v[low(n, q)] + (v[F.least(low(n, q) + 1, n - 1)] - v[low(n, q)]) * ((n - 1) * q - low(n, q))).alias(value)) for q in at]
    return held.select(*keys, F.explode(F.array(*each)).alias("_e")).select(*keys, "_e.q", f"_e.{value}")
