import random
import zlib

from pyspark.sql import functions as F

from quaylight.llm import sharding
from quaylight.llm.common import table


def plain_best_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(c, b) for b, c in enumerate(bins) if c >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            bins.append(capacity)
            b = len(bins) - 1
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_packs_as_a_scan_does():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        cap = rng.randrange(60, 120)
        assert sharding.best_fit_decreasing(sizes, cap) == plain_best_fit(sizes, cap)
    assert sharding.best_fit_decreasing([], 5) == []
    assert sharding.best_fit_decreasing([9, 1], 5) == [0, 1]


def test_pack_uses_no_more_bins_than_asked():
    rng = random.Random(2)
    for n in (1, 3, 24):
        sizes = [rng.randrange(1, 1000) for _ in range(200)]
        bins = sharding.pack(sizes, n)
        loads = [sum(s for s, b in zip(sizes, bins, strict=True) if b == i) for i in range(n)]
        assert max(bins) < n
        assert max(loads) - min(loads) <= 1000


def test_op7(spark, tiny):
    rows = sharding.op7(spark, tiny).collect()
    docs = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs.items()}
    assert {r.law for r in rows} == {"bytes"}
    loads, slots, homes = {}, {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert set(loads) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def sharded(rows, **how):
    return sharding.shard(rows, size=F.col("size"), group=F.col("grp"), **how)


def test_capacity_and_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.withColumn("size", F.length("text")).withColumn("grp", F.col("text"))
    for c in ("pool", "at", "start", "_grp", "_tie", "_part", "_shard", "_slot", "_at", "_s1"):
        rows = rows.withColumn(c, F.lit("mine"))
    out = sharded(rows, capacity=4000).collect()
    assert len(out) == odd_docs.count()
    assert {tuple(r._row) for r in out} == {tuple(r) for r in rows.collect()}
    for s in {r._shard for r in out}:
        assert sorted(r._slot for r in out if r._shard == s) == list(range(sum(r._shard == s for r in out)))
    assert sharded(no_docs.select("doc_id", F.col("n_chars").alias("size"), F.col("text").alias("grp")), shards=3).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(5).alias("size"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("grp"))
    got = sharded(hot, shards=2, pools=16).groupBy("_shard").agg(F.sum("_size").alias("n")).collect()
    assert max(r.n for r in got) - min(r.n for r in got) <= 1500


def test_many_shards_are_packed_from_a_bounded_number_of_items(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ITEMS", 1000)
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(5).alias("size"), F.col("id").alias("grp"))
    seen = []
    pack = sharding.best_fit_decreasing
    monkeypatch.setattr(sharding, "best_fit_decreasing", lambda sizes, capacity: seen.append(len(sizes)) or pack(sizes, capacity))
    loads = [r.n for r in sharded(rows, capacity=1000).groupBy("_shard").agg(F.sum("_size").alias("n")).collect()]
    assert max(loads) <= 1000
    assert seen[0] <= 2 * 1000 + 100


def test_large_groups_leave_no_shard_empty(spark):
    rng = random.Random(3)
    small = [rng.randrange(1, 1000) for _ in range(12000)]
    for share in (0.05, 0.1, 1 / 3, 0.99):
        sizes = [*small, int(sum(small) * share / (1 - share))]
        bins = sharding.pack(sizes, 24)
        loads = [0] * 24
        for s, b in zip(sizes, bins, strict=True):
            loads[b] += s
        others = [n for b, n in enumerate(loads) if b != bins[-1]]
        assert loads[bins[-1]] == sizes[-1]
        assert max(others) <= 1.02 * min(others)
    bins = sharding.pack([5] * 4, 3)
    assert sorted(bins.count(b) for b in range(3)) == [1, 1, 2]
    assert sharding.pack([5, 3], 3) == [0, 1]
    assert sharding.pack([], 3) == []


def test_op7_with_a_group_of_a_third(spark, tmp_path):
    text = F.concat(F.lit("text "), F.md5(F.col("id").cast("string")))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " + "c" * 32)).otherwise(text).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    loads = sorted(r.n for r in sharding.op7(spark, str(tmp_path)).groupBy("shard").agg(F.sum("size").alias("n")).collect())
    assert len(loads) == 24
    assert loads[-1] == 3000 * 45
    assert loads[-2] <= 1.05 * loads[0]
