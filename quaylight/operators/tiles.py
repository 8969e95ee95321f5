"""Query blocks against parts of the rows: pairs are scored by arrays within tasks."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block and rows of a part. A pair of them is what a task holds at a time.
QUERIES, ROWS = 4096, 32768


def tiled(queries: DataFrame, rows: DataFrame, by: str, of: str, each: Callable, schema: str) -> DataFrame:
    """JN26: ``each(block, part)`` for every block of a stated query set and every part of
    the rows, as Arrow tables of bounded size, however many rows there are."""
    n, m = queries.count(), rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // QUERIES))
    parts = max(1, -(-m // ROWS), min(-(-2 * cores // blocks), -(-m // 256)))
    deal = lambda d, key, own, k, other, l: d.withColumns({own: F.pmod(F.xxhash64(key, F.lit(3)), F.lit(k)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(l - 1)))}).repartition(min(blocks * parts, 16 * cores), "_block", "_part")  # noqa: E731, E741
    q, r = deal(queries, by, "_block", blocks, "_part", parts), deal(rows, of, "_part", parts, "_block", blocks)
    return q.groupBy("_block", "_part").cogroup(r.groupBy("_block", "_part")).applyInArrow(each, schema)


def rounded(x: np.ndarray) -> np.ndarray:
    """Rounded to six places as Spark does it: halves of the shortest decimal away from 0."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * 1e6
        out = np.where(y < 2.0**52, np.copysign(np.floor(y + 0.5) / 1e6, x), x)
        close = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-6 + y * 1e-15) & (y < 2.0**52))
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class Best:
    """The k best rows of each of n queries so far: least tier, greatest rounded score (a
    NaN is greater than all), least key."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.tier, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.key = None
        #: Tier and score of the last of k; what is worse can't be among them.
        self.last_tier, self.last = np.full(n, np.iinfo(np.int64).max), np.full(n, -np.inf)

    def add(self, q: np.ndarray, tier: np.ndarray, raw: np.ndarray, key: np.ndarray) -> None:
        if not len(q):
            return
        key = key if self.key is None else np.concatenate([self.key, key])
        q, tier, raw = np.concatenate([self.q, q]), np.concatenate([self.tier, tier]), np.concatenate([self.raw, raw])
        score, odd = rounded(raw), np.isnan(raw)
        order = np.lexsort((key, -np.where(odd, np.inf, score), ~odd, tier, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = order[place < self.k]
        self.q, self.tier, self.raw, self.key = q[place < self.k], tier[keep], raw[keep], key[keep]
        full = order[place == self.k - 1]
        at = q[place == self.k - 1]
        self.last_tier[at] = tier[full]
        self.last[at] = np.where(odd[full], np.inf, score[full])


def matrices(keys: pa.ChunkedArray, arrays: pa.ChunkedArray):
    """{dimension: (places of the rows, matrix)} of the arrays without nulls."""
    arrays = arrays.combine_chunks()
    arrays = arrays if isinstance(arrays, pa.Array) else pa.concat_arrays(arrays.chunks)
    ends = arrays.offsets.to_numpy()
    sizes, flat = np.diff(ends), arrays.values.to_numpy(zero_copy_only=False).astype(np.float64)
    whole = arrays.is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().combine_chunks().to_numpy(zero_copy_only=False)
    if arrays.values.null_count:
        lost = np.r_[0, np.cumsum(arrays.values.is_null().to_numpy(zero_copy_only=False))]
        whole &= lost[ends[1:]] == lost[ends[:-1]]
    for d in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == d))
        yield int(d), at, flat[ends[at][:, None] + np.arange(d)]
