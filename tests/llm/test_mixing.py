import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaylight.llm import mixing
from quaylight.llm.common import table


def reshare(sizes, weights, share, most):
    """Targets by handing on the excess until none is above."""
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    left = min(left, most * sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_op10(spark, tiny):
    rows = mixing.op10(spark, tiny).collect()
    docs = {r.doc_id: r for r in table(spark, tiny, "documents").collect()}
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.encode().split())
        assert 0 <= r.taken <= 2 * r["size"]
        s = docs[r.doc_id].source
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: s.encode()))}
    want = reshare(sizes, weights, 1.5, 2.0)
    largest = max(r["size"] for r in rows)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest
    again = {r.doc_id: r.taken for r in mixing.op10(spark, tiny).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def mixed(rows, weights, share, most, quality=None):
    out = mixing.mix(rows, weights, share, most, measure=F.struct("size", (F.lit(1.0) if quality is None else quality).alias("q")), size=lambda m: m["size"], quality=lambda m: m["q"])
    return out.select("_row.*", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"))


def test_quality_weights_prefer_and_epochs_are_complete(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("size"))
    q = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    out = mixed(rows, (1,), 0.5, 2.0, quality=q)
    n = {r.p: r.n for r in out.groupBy((F.col("doc_id") % 2).alias("p")).agg(F.sum("copies").alias("n")).collect()}
    assert n[0] + n[1] == 2000
    assert n[0] > 1.8 * n[1]
    assert mixed(rows, (1,), 1.5, 2.0).agg(F.min("copies"), F.max("copies"), F.sum("copies")).first()[:] == (1, 2, 6000)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(150)]), rng.choice(["a", "b", None]), rng.randrange(0, 40)) for _ in range(400)]
    rows += [(7, "a", 30)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    q = 1 + F.pmod(F.coalesce("doc_id", F.lit(3)), F.lit(7))
    for share in (0.2, 0.5, 1.5):
        tie = F.xxhash64("doc_id", "source", "size")
        keyed = df.withColumn("tie", tie).withColumn("key", -F.log(mixing.unit("doc_id", F.when(F.col("doc_id").isNull(), tie), F.lit(1))) / q)
        want, targets = Counter(), {}
        by = {}
        for r in keyed.collect():
            by.setdefault(r.source, []).append(r)
        sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
        names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        targets = reshare(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, share, 2.0)
        for s, own in by.items():
            epochs, at = int(targets[s] // sizes[s]), 0
            left = targets[s] - epochs * sizes[s]
            for r in sorted(own, key=lambda r: (r.key, r["size"], r.tie)):
                again = r["size"] > 0 and at + r["size"] / 2 <= left
                at += r["size"]
                want[(r.doc_id, s, r["size"], epochs + again)] += 1
        got = Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixed(df, (5, 2, 1), share, 2.0, quality=q).collect())
        assert got == want


def test_ranges_are_even_whatever_the_qualities(spark):
    n = 200_000
    for top in (1, 1000):
        q = 1 + F.pmod(F.col("id") * 7919, F.lit(top))
        key = -F.log(mixing.unit("id", F.lit(1))) / q
        most = spark.range(n).groupBy(mixing.key_range(key)).count().agg(F.max("count")).first()[0]
        assert most < n * 0.0005 * 1.6


def test_quality_of_texts(spark):
    texts = ["prose of quite usual words that run on and on for a while until there are enough of them to count as a text here.", "1.\n2.\n3.\n4.\n5.\n6.\n7.\n8.\n9.\n0", "", None]
    got = [r.q for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(mixing.prose_weight(mixing.text_counts("text")).alias("q")).collect()]
    assert got[0] > 0.9
    assert got[1] < 0.2
    assert got[2:] == [0.05, 0.05]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.withColumn("size", mixing.n_words("text"))
    for c in ("copies", "target", "_size", "_key", "_range", "_bound", "_left", "_epochs"):
        rows = rows.withColumn(c, F.lit("mine"))
    out = mixing.mix(rows, (5, 2, 1), 1.5, 2.0, measure=F.col("size"), size=lambda m: m, quality=lambda m: F.lit(None)).collect()
    assert len(out) == odd_docs.count()
    assert all(r._copies <= 2 and r._row.copies == r._row._key == "mine" for r in out)
    assert {r._source_size for r in out if r._row.source is None} == {5}
    assert mixing.mix(no_docs, (1,), 1.0, 1.0, measure=F.lit(1), size=lambda m: m, quality=lambda m: F.lit(1.0)).count() == 0
