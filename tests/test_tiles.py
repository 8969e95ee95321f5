"""Searches by blocks of queries and parts of rows, against every pair."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import textsearch as TS
from quaylight.operators import tiles
from quaylight.operators import vectorsearch as V


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def total(terms):
    # sum() of Python carries what it loses
    return reduce(lambda s, x: s + x, terms, 0.0)


def score(kind, a, b):
    dot = total(x * y for x, y in zip(a, b, strict=True))
    if kind == "l2":
        return -total((x - y) * (x - y) for x, y in zip(a, b, strict=True))
    n = math.sqrt(total(x * x for x in a)) * math.sqrt(total(x * x for x in b))
    return dot if kind == "inner" else dot / n if n else None


@pytest.fixture(scope="module")
def vectors(spark):
    """Many copies and ties, nulls, another dimension, zeros, large and small numbers."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(6)], rng.choice([1, 2, 3, 4, None])) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0], 2) for i in range(60)]
    rows += [(360 + i, [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 7) for _ in range(6)], 1) for i in range(40)]
    rows += [(400, None, 1), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (402, [1.0, 2.0], 1), (403, [2.0, 1.0], 3), (404, [0.0] * 6, 2), (420, [2.0, 2.0], 1)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(7).cache()


@pytest.mark.parametrize("kind", ["l2", "inner", "cosine"])
@pytest.mark.parametrize("tiered", [False, True])
def test_nearest_of_every_pair(vectors, monkeypatch, kind, tiered):
    rows, df = vectors
    monkeypatch.setattr(tiles, "QUERIES", 8)
    monkeypatch.setattr(tiles, "ROWS", 64)
    tiers = (F.col("label"), F.col("label") % 2) if tiered else ()
    got = V.knn(df.where("id % 20 = 0"), df, "id", "v", 7, kind, tiers).select("query", "id", "tier", "score", "rank").collect()
    want = []
    for q, a, l in rows:
        if q % 20 or a is None or None in a:
            continue
        mine = []
        for i, b, m in rows:
            if i == q or b is None or None in b or len(a) != len(b) or (s := score(kind, a, b)) is None:
                continue
            t = 0 if not tiered or (l is not None and l == m) else 1 if None not in (l, m) and l % 2 == m % 2 else 2
            mine.append((t, -half_up(s), i))
        want += [(q, i, t, -s, k) for k, (t, s, i) in enumerate(sorted(mine)[:7], 1)]
    assert sorted((r["query"], r["id"], r["tier"], r["score"] + 0.0, r["rank"]) for r in got) == sorted((*x[:3], x[3] + 0.0, x[4]) for x in want)


def test_inner_products_are_counted(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(tiles, "QUERIES", 8)
    monkeypatch.setattr(tiles, "ROWS", 64)
    df, rows = df.where("id < 360"), rows[:360]
    got = {r["score"]: (r["c"], r["p"]) for r in V.inner_tally(df.where("id % 20 = 0"), df, "id", "v", "label").collect()}
    want = {}
    for q, a, l in rows[::20]:
        for i, b, m in rows:
            if i != q:
                c, p = want.get(s := half_up(score("inner", a, b)), (0, 0))
                want[s] = c + 1, p + (l is not None and l == m)
    assert got == want


def test_rounding_is_that_of_spark(spark):
    x = [0.1234565, -0.1234565, 1.0000005, 2.5e-7, -5e-7, 4.9999999e-7, 123456.7890125, 1e17, -1e300, float("inf"), 0.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert (tiles.rounded(np.array(x)) == np.array(want)).all()


def test_likeness_of_every_pair(spark, monkeypatch):
    """Ties, weights of 0, copies and a query without a group, over many blocks and parts."""
    monkeypatch.setattr(TS, "QUERIES", 4)
    monkeypatch.setattr(TS, "DOCUMENTS", 16)
    monkeypatch.setattr(TS, "SCORED", 64)
    rng = random.Random(3)
    rows = [(i, ["a", "b", None][i % 3], f"t{t}", rng.choice([0.0, 0.5, 1.0, 2.0])) for i in range(120) for t in rng.sample(range(12), 5)]
    df = spark.createDataFrame(rows, "id long, g string, term string, w double")
    got = TS.more_like_this(df, df.where("id % 5 = 0").select("id").distinct(), "id", 3, 6, ("g",)).collect()
    docs = {}
    for i, g, t, w in rows:
        docs.setdefault(i, (g, {}))[1][t] = w
    want = []
    for i, (g, mine) in docs.items():
        if i % 5 == 0 and g:
            heavy = sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:3]
            score = lambda o: sum(w * o[t] for t, w in heavy if t in o)  # noqa: B023, E731
            found = sorted((-score(o), j) for j, (of, o) in docs.items() if j != i and of == g and any(t in o for t, _ in heavy))
            want += [(i, j, -s, k) for k, (s, j) in enumerate(found[:6], 1)]
    assert sorted((r["query"], r["id"], r["score"], r["rank"]) for r in got) == sorted(want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_of_every_pair(spark):
    """Names of one class, names a few letters long, an empty one and groups of one."""
    rng = random.Random(7)
    words = ["red", "reed", "rad", "blue", "blew", "b", "", "ring", "rings", "wring"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))), i % 4) for i in range(160)] + [(200, "alone", 9), (220, None, 1)]
    df = spark.createDataFrame(rows, "id long, name string, size int")
    got = sorted(tuple(r) for r in TS.fuzzy_names(df.where("id % 20 = 0"), df, "id", "name", 6).select("query", "hit", "score", "rank").collect())
    sets = {i: {w for w in (n or "").split(" ") if w} for i, n, _ in rows}
    want = []
    for q in (i for i in sets if i % 20 == 0):
        score = lambda i: sum(max([{0: 4, 1: 2, 2: 1}.get(edits(a, b), 0) for b in sets[i] if a[0] == b[0]], default=0) for a in sets[q])  # noqa: B023, E731
        found = sorted((-s, i) for i in sets if (s := score(i)))[:6]
        want += [(q, i, -s, k) for k, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)
    named = df.where("name IS NOT NULL")
    got = sorted(tuple(r) for r in TS.nearest_names(named.where("id % 20 = 0"), named, "id", "name", "size").collect())
    want = []
    for q, name, size in rows:
        if q % 20 == 0 and name is not None and (near := sorted((edits(name, n), i) for i, n, s in rows if s == size and i != q and n is not None)):
            exact = sum(e == 0 for e, _ in near)
            want.append((q, near[0][1] if near[0][0] <= 2 else None, exact, exact > 1))
    assert got == sorted(want)


def test_only_asked_postings_are_weighted(spark):
    """What ``retrieved`` finds from postings is what ``more_like_this`` finds from weights, and
    what is explained of a pair adds up to its score."""
    rng = np.random.default_rng(9)
    rows = [(d, "ab"[d % 2], f"t{t}", int(rng.integers(1, 6))) for d in range(60) for t in rng.choice(40, 12, replace=False)]
    p = spark.createDataFrame(rows, "id long, g string, term string, tf long")
    i = TS.with_idf(TS.frequencies(p), p.select("id").distinct())
    asked = p.where("id % 5 = 0").select("id").distinct()
    heavy = TS.heaviest(p, i, asked, "id", 3, ("g",))
    found = TS.retrieved(p, heavy, "id", 6, ("g",), 60)
    want = TS.more_like_this(TS.tfidf(p, i, "id"), asked, "id", 3, 6, ("g",))
    rows = {(r.query, r.id, r.score, r.rank) for r in found.collect()}
    assert rows == {(r.query, r.id, r.score, r.rank) for r in want.collect()} and len(rows) > 50
    parts = TS.explained(p, found, heavy, "id").groupBy("query", "id").agg(F.sum("contribution").alias("s")).collect()
    assert {(r.query, r.id): r.s for r in parts} == pytest.approx({r[:2]: r[2] for r in rows}, abs=1e-6)


def test_terms_of_pairs_are_merged_where_postings_are_dealt_by_term(spark, tmp_path):
    """Pairs are sent, postings meet the terms' idf in a shuffle: a term of both sides is one row."""
    post = spark.range(400).select(F.col("id").alias("doc"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("t"), F.pmod(F.xxhash64("id", i), F.lit(60))))).alias("term")).distinct()
    idfs = spark.range(60).select(F.concat(F.lit("t"), "id").alias("term"), (F.col("id") + 100.0).alias("idf"))
    pairs = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 3 + 5).alias("b"))
    for name, df in (("post", post), ("idf", idfs), ("pairs", pairs)):
        df.write.parquet(f"{tmp_path}/{name}")
    post, idfs, pairs = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("post", "idf", "pairs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = TS.pair_terms(F.broadcast(pairs), post, idfs, "a", "b", "doc")
        got = {(r.a, r.b): r.peer_only_idf for r in TS.peer_only(terms, "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {}
    for r in post.collect():
        held.setdefault(r.doc, []).append(int(r.term[1:]))
    own = {(a, a * 3 + 5): sorted((100.0 + t for t in set(held[a * 3 + 5]) - set(held[a])), reverse=True) for a in range(100)}
    assert got == pytest.approx({p: sum(w[:10]) / min(len(w), w[0]) for p, w in own.items() if w}, abs=1e-6)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_bounded_by_a_sample_loses_nothing(spark, monkeypatch, k):
    """Above ``SMALL`` documents light postings are left out of the search, and results are
    those of the whole one."""
    rng = np.random.default_rng(k)
    rows = [(d, "aab"[d % 3], f"t{t}", float(rng.integers(1, 6) * (1 + t % 7)) / 7) for d in range(400) for t in np.unique(rng.zipf(1.3, 30) % 80)]
    w = spark.createDataFrame(rows, "id long, g string, term string, w double")
    asked = w.where("id % 5 = 0").select("id").distinct()
    want = TS.more_like_this(w, asked, "id", 6, k, ("g",)).collect()
    monkeypatch.setattr(TS, "SMALL", 20)
    monkeypatch.setattr(TS, "SAMPLED", 4)
    monkeypatch.setattr(TS, "HITS", 500)
    got = TS.more_like_this(w, asked, "id", 6, k, ("g",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50
