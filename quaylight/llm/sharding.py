"""Sharding by best-fit-decreasing bin packing.

Groups (rows that must stay together) enter, largest first, the bin with the
tightest remaining capacity that still holds them; bins are kept in a balanced
tree by remaining capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import forget, packed, small, stored, table

#: Buckets that small groups are pooled in, for each shard; with many shards, so many
#: that the driver packs about 2 * ITEMS items, but LEAST_POOLS a shard at least.
POOLS, LEAST_POOLS = 512, 8
ITEMS = 1 << 20
#: Parts that the rows of a shard are numbered in.
PARTS = 512


class CapacityTree:
    """AVL tree of (remaining capacity, bin)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(t):
        return t[3] if t else 0

    def _node(self, left, key, right):
        return (left, key, right, 1 + max(self._height(left), self._height(right)))

    def _balance(self, left, key, right):
        lean = self._height(left) - self._height(right)
        if lean > 1:
            if self._height(left[0]) < self._height(left[2]):
                mid = left[2]
                left = self._node(self._node(left[0], left[1], mid[0]), mid[1], mid[2])
            return self._node(left[0], left[1], self._node(left[2], key, right))
        if lean < -1:
            if self._height(right[2]) < self._height(right[0]):
                mid = right[0]
                right = self._node(mid[0], mid[1], self._node(mid[2], right[1], right[2]))
            return self._node(self._node(left, key, right[0]), right[1], right[2])
        return self._node(left, key, right)

    def add(self, key):
        def into(t):
            if t is None:
                return self._node(None, key, None)
            return self._balance(into(t[0]), t[1], t[2]) if key < t[1] else self._balance(t[0], t[1], into(t[2]))

        self.root = into(self.root)

    def remove(self, key):
        def least(t):
            while t[0]:
                t = t[0]
            return t[1]

        def out(t, key):
            if key < t[1]:
                return self._balance(out(t[0], key), t[1], t[2])
            if key > t[1]:
                return self._balance(t[0], t[1], out(t[2], key))
            if not t[0] or not t[2]:
                return t[0] or t[2]
            nxt = least(t[2])
            return self._balance(t[0], nxt, out(t[2], nxt))

        self.root = out(self.root, key)

    def tightest(self, size):
        """Least (capacity, bin) with capacity >= size, or None."""
        t, best = self.root, None
        while t:
            if t[1][0] >= size:
                best, t = t[1], t[0]
            else:
                t = t[2]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each group; a new bin opens only when no open one holds the group.
    A group above the capacity gets a bin of its own. Equal sizes keep their
    order, equal capacities the lower bin; no groups, no bins."""
    tree, out, bins = CapacityTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.tightest(sizes[i])
        if found:
            tree.remove(found)
            left, out[i] = found[0] - sizes[i], found[1]
        else:
            left, out[i], bins = capacity - sizes[i], bins, bins + 1
        if left > 0:
            tree.add((left, out[i]))
    return out


def alone(sizes: list[int], total: int, shards: int) -> int:
    """How many of ``sizes`` (largest first, of groups that sum to ``total``) get a
    shard of their own: each is above the mean of what then remains."""
    n = 0
    while n < len(sizes) and sizes[n] * (shards - n) > total:
        total -= sizes[n]
        n += 1
    return n


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins for a fixed number of shards. Groups above the mean of what remains have
    a bin each; the others get the least capacity at which best-fit-decreasing needs
    no more than the remaining bins. A bin that stays empty takes groups of the
    fullest: none is unused while another holds two groups."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    n = alone([sizes[i] for i in order], sum(sizes), shards)
    out = [0] * len(sizes)
    for b, i in enumerate(order[:n]):
        out[i] = b
    rest = order[n:]
    if rest:
        for i, b in zip(rest, _least_capacity([sizes[i] for i in rest], shards - n), strict=True):
            out[i] = n + b
    held: list[list[int]] = [[] for _ in range(shards)]
    for i in order:
        held[out[i]].append(i)
    for b in [b for b in range(shards) if not held[b]]:
        full = max((x for x in range(shards) if len(held[x]) > 1), key=lambda x: sum(sizes[i] for i in held[x]), default=None)
        if full is None:
            break
        parts, loads = ([], []), [0, 0]
        for i in held[full]:
            x = min((0, 1), key=lambda x: (loads[x], len(parts[x])))
            parts[x].append(i)
            loads[x] += sizes[i]
        held[full], held[b] = parts
        for i in held[b]:
            out[i] = b
    return out


def _least_capacity(sizes: list[int], shards: int) -> list[int]:
    low = max([1, -(-sum(sizes) // shards), *sizes])
    high, best = low, None
    while best is None:
        found = best_fit_decreasing(sizes, high)
        if max(found) < shards:
            best = found
        else:
            low, high = high + 1, high + max(1, high // 512)
    step = max(1, high // 20000)
    while high - low > step:
        mid = (low + high) // 2
        found = best_fit_decreasing(sizes, mid)
        if max(found) < shards:
            best, high = found, mid
        else:
            low = mid + 1
    return best


def shard(rows: DataFrame, size: Column, group: Column, shards: int | None = None, capacity: int | None = None, pools: int = POOLS) -> DataFrame:
    """``_row``, ``_size``, ``_shard`` and ``_slot`` of every row of ``rows`` (doc_id and
    any others): its columns in one struct, and where it goes. ``size`` and ``group`` are
    expressions over its columns.

    Rows of equal ``group`` share a shard. With ``capacity`` the number of shards is
    minimised; with ``shards`` the capacity is, and a group above the mean of what
    remains has a shard of its own. Groups above a pool's share are packed one by one:
    at most ``pools`` + 1 times the shards of them can exist. Smaller ones are pooled by
    hash first, so that the driver packs a bounded number of items however many groups
    there are; a pool is never divided, nor is a group. The slot counts from 0 in each
    shard, by (part, doc_id), where the part is a hash of the row: no shard is numbered
    by one task. Null sizes are 0, null groups are one group; rows of one doc_id are in
    the order of size and a hash of all columns, and rows repeated whole in any; an
    empty table gives no rows; columns of any name pass through.
    """
    spark = rows.sparkSession
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t))
    wide = rows.select(packed(rows.columns), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.xxhash64(group).alias("_grp"), F.col("doc_id").alias("_id"), tie.alias("_tie"))
    wide = wide.withColumn("_part", F.pmod(F.xxhash64("_tie", "_id"), F.lit(PARTS)).cast("int"))
    narrow = stored(wide.select("_grp", "_size", "_part"), "sized")
    groups = stored(narrow.groupBy("_grp").agg(F.sum("_size").alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    shards_about = shards or max(1, -(-total // max(1, capacity)))
    n_pools = shards_about * max(LEAST_POOLS, min(pools, ITEMS // shards_about))
    if shards:
        # What has a shard of its own doesn't count in a pool's share.
        tops = [r.n for r in groups.orderBy(F.desc("n")).limit(shards).collect()]
        total -= sum(tops[: alone(tops, total, shards)])
    least = max(1, total // n_pools)
    large = [(r["_grp"], None, r.n) for r in groups.where(F.col("n") > least).collect()]
    pool = F.pmod(F.xxhash64("_grp", F.lit(7)), F.lit(n_pools))
    few = [(None, r.pool, r.n) for r in groups.where(F.col("n") <= least).groupBy(pool.alias("pool")).agg(F.sum("n").alias("n")).collect()]
    items = sorted(large + few, key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1] or 0))
    sizes = [x[2] for x in items]
    bins = pack(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    # At most 2 * n_pools + shards rows, whatever the input.
    where = stored(spark.createDataFrame([(g, p, b) for (g, p, _), b in zip(items, bins, strict=True)], "g long, p long, shard int"), "bins")
    by_group = small(where.where("g IS NOT NULL").select(F.col("g").alias("_grp"), F.col("shard").alias("_s1")))
    by_pool = small(where.where("p IS NOT NULL").select(F.col("p").alias("_pool"), F.col("shard").alias("_s2")))

    def placed(df: DataFrame) -> DataFrame:
        found = df.withColumn("_pool", pool).join(by_group, "_grp", "left").join(by_pool, "_pool", "left")
        return found.withColumn("_shard", F.coalesce("_s1", "_s2")).drop("_pool", "_s1", "_s2", "_grp")

    before = W.Window.partitionBy("_shard").orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    # At most PARTS rows for each shard.
    starts = placed(narrow).groupBy("_shard", "_part").agg(F.count("*").alias("n")).select("_shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    starts = stored(starts, "starts")
    forget(narrow, groups)
    at = F.row_number().over(W.Window.partitionBy("_shard", "_part").orderBy("_id", "_size", "_tie"))
    return placed(wide).withColumn("_at", at).join(small(starts), ["_shard", "_part"]).select("_row", "_size", "_shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("_slot"))


def text_group(text: str | Column) -> Column:
    """Names equal texts; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text), F.length(text))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 8).alias("size"), text_group("text").alias("grp"))
    out = shard(docs, size=F.col("size"), group=F.col("grp"), shards=24)
    return out.select("_row.doc_id", F.col("_size").alias("size"), "_row.text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
