"""The learned factors and topics against small numpy versions."""

import numpy as np
import pytest

from quaylight.operators import learn as L
from quaylight.plans import learning as PL


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Many rounds over few rows: one task a shuffle."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_nmf(x, w, h, steps, bound=1e-4):
    first = before = np.linalg.norm(x - w @ h.T)
    for step in range(1, steps + 1):
        w = w * (x @ h) / (w @ (h.T @ h) + 1e-12)
        h = h * (x.T @ w) / (h @ (w.T @ w) + 1e-12)
        if step % 10 == 0:
            now = np.linalg.norm(x - w @ h.T)
            if before - now < bound * first:
                break
            before = now
    return w, h, step


def starts(spark, kind, n, k):
    df = spark.range(n).selectExpr(f"cast(id AS {kind}) AS c", f"transform(sequence(1, {k}), i -> (pmod(xxhash64(cast(id AS {kind}), i), 1000) + 1) / 1000.0D) AS f")
    return np.array([r.f for r in sorted(df.collect(), key=lambda r: int(r.c))], float)


def test_nmf_to_its_bound(spark):
    rng = np.random.default_rng(1)
    x = rng.random((8, 2)) @ rng.random((2, 6)) + 0.05 * rng.random((8, 6))
    rows = [(d, str(t), float(x[d, t])) for d in range(8) for t in range(6)]
    df = spark.createDataFrame(rows, "d long, t string, x double").coalesce(1)
    w, h, steps = plain_nmf(x, starts(spark, "bigint", 8, 2), starts(spark, "string", 6, 2), 30, 0.01)
    got = L.nmf(df, "d", "t", "x", 2, steps=30, bound=0.01).collect()
    assert steps >= 10
    np.testing.assert_allclose([r.factors for r in sorted(got, key=lambda r: r.d)], w, rtol=1e-6, atol=1e-9)


def plain_topics(post, steps, alpha=0.1):
    from math import exp, log

    def digamma(x):
        y = x + 6
        return log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))

    def counts(weighted):
        phi = {}
        for (_, term, tf, g), q in weighted:
            for key, v in (((g, term), tf * q[0]), (("*", term), tf * q[1])):
                phi[key] = phi.get(key, 0.0) + v
        return phi

    phi, theta = counts([(p, (1.0, 1.0)) for p in post]), {p[0]: [1.0, 1.0] for p in post}
    for _ in range(steps):
        total, weighted = {}, []
        for (g, _), n in phi.items():
            total[g] = total.get(g, 0.0) + n
        for p in post:
            d, term, _, g = p
            a = phi[g, term] / total[g] * exp(digamma(theta[d][0] + alpha))
            b = phi["*", term] / total["*"] * exp(digamma(theta[d][1] + alpha))
            weighted.append((p, (a / (a + b), b / (a + b))))
        theta = {p[0]: [0.0, 0.0] for p in post}
        for (d, _, tf, _), q in weighted:
            theta[d][0] += tf * q[0]
            theta[d][1] += tf * q[1]
        phi = counts(weighted)
    total = {}
    for (g, _), n in phi.items():
        total[g] = total.get(g, 0.0) + n
    return {k: n / total[k[0]] for k, n in phi.items()}


def test_registered_topics_run_all_rounds(spark, monkeypatch):
    post = [(d, t, float(1 + (d * 7 + i * 3) % 5), "ab"[d % 2]) for d in range(6) for i, t in enumerate(["x", "y", "z", "uv"[d % 2]])]
    df = spark.createDataFrame(post, "doc_id long, term string, tf double, source string").coalesce(1)
    monkeypatch.setattr(PL.TX, "post", lambda spark, sf: df.drop("source"))
    monkeypatch.setattr(PL.TX, "docs", lambda spark, sf: df.select("doc_id", "source").distinct())
    got = {(r.topic, r.term): r.phi for r in PL.lda_industry(spark, "").collect()}
    want = plain_topics(post, 50)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert max(abs(want[k] - v) for k, v in plain_topics(post, 2).items()) > 1e-3


def plain_dtw(a, b, window):
    n, m = len(a), len(b)
    window = max(window, abs(n - m))
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - window), min(m, i + window) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return cost[n, m]


@pytest.mark.parametrize("window", [0, 1, 3, 50])
def test_dtw_by_diagonals(spark, window):
    rng = np.random.default_rng(window)
    pairs = [(rng.standard_normal(n), rng.standard_normal(m)) for n, m in [(1, 1), (5, 5), (5, 5), (7, 3), (2, 9), (12, 12), (1, 6)]]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)] + [(90, None, [1.0]), (91, [1.0], []), (92, [], [])], "i int, a array<double>, b array<double>")
    got = {r.i: r.d for r in df.select("i", L.dtw(df.a, df.b, window).alias("d")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_dtw(a, b, window))
    assert got[90] is None and got[91] is None and got[92] is None


def test_topics_and_factors_of_no_rows(spark):
    none = spark.createDataFrame([], "d long, term string, tf double, g string")
    assert L.industry_topics(none, "d", "g", 3).count() == 0
    assert L.nmf(none, "d", "term", "tf", 3).count() == 0


def test_rounds_of_topics_write_counts_only(spark, monkeypatch):
    """A round writes a number a pair, term and document, and not the documents again."""
    from quaylight.operators import factors

    written = []
    monkeypatch.setattr(factors, "kept", lambda df, name, own=factors.kept: written.append(df.columns) or own(df, name))
    post = [(d, f"t{(d * 3 + i) % 11}", 1.0 + i, "ab"[d % 2]) for d in range(9) for i in range(4)] + [(None, "t1", 2.0, "a")]
    got = {(r.topic, r.term): r.phi for r in L.industry_topics(spark.createDataFrame(post, "d long, term string, tf double, g string"), "d", "g", 4).collect()}
    want = plain_topics(post, 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert written[-4:] == [["block", "pairs", "words", "chunk", "data"]] * 4


def test_ranknet_of_lists_is_that_of_their_pairs(spark):
    from pyspark.sql import functions as F

    from quaylight.operators import ranking as K

    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], int(rng.integers(0, 3)), float(rng.integers(0, 6)), float(rng.integers(0, 2))) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, 2, 1.0, 1.0), (61, "a", 1, None, 1.0)], "i int, list string, rel int, x double, y double")
    own = df.where("x IS NOT NULL").select("i", "x", "y")
    pairs = K.preferences(df, ["list"], "i", "rel").join(own.toDF("better", "x1", "y1"), "better").join(own.toDF("worse", "x2", "y2"), "worse").select((F.col("x1") - F.col("x2")).alias("x"), (F.col("y1") - F.col("y2")).alias("y"))
    weights = L.ranknet(pairs, ["x", "y"])
    got, importance = L.ranknet_lists(df, ["list"], "rel", ["x", "y"])
    assert got == pytest.approx(weights, abs=1e-5)
    assert importance == pytest.approx({r.feature: r.importance for r in L.importance(pairs, weights).collect()}, abs=1e-4)
