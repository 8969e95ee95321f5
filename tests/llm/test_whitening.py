import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from quaylight.llm import whitening


def plain(vectors):
    """Eigenvectors of the whole covariance, and exact deviations."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[c - 1000000 - (s - 1000000 * n) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors[:, ::-1]


def test_op12(spark, tiny):
    t = pq.read_table(f"{tiny}/embeddings.parquet")
    n, deviation, centred, values, vectors = plain(t["embedding"].to_pylist())
    at = {v: i for i, v in enumerate(t["vec_id"].to_pylist())}
    rows = whitening.op12(spark, tiny).collect()
    k = min(32, centred.shape[1])
    assert len(rows) == n * k
    got = np.zeros((n, k))
    for r in rows:
        assert r.n == n and r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error <= 1e-8
        got[at[r.vec_id], r.component - 1] = r.whitened
    for c in range(k):
        want = centred @ vectors[:, c] / math.sqrt(values[c])
        want *= np.sign(want @ got[:, c])
        assert np.abs(want - got[:, c]).max() < 1e-6


@pytest.mark.parametrize("noise", [0.01, 1.0])
def test_passes_until_residuals_certify(spark, noise):
    """A space wider than the block, with and without a gap after the components."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 40)) * 3 + noise * rng.standard_normal((400, 40))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    w = whitening.fit(rows, "v", 3)
    _, _, centred, values, vectors = plain(x)
    assert w.passes > 1
    assert w.values == pytest.approx(values[:3], rel=1e-11)
    for c in range(3):
        assert abs(abs(vectors[:, c] @ w.components[:, c]) - 1) < 1e-12
    assert w.trace == pytest.approx(values.sum(), rel=1e-12)
    assert whitening.identity_error(rows, "v", w) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [1e30, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, _row int")
    out, w = whitening.whiten(df, "embedding", 5)
    got = out.select("_row.*", "_deviation", "_whitened").collect()
    assert sorted((r.vec_id or -1) for r in got) == [-1, 1, 1, 2]
    assert w.n == 4 and all(len(r._whitened) == 2 for r in got)
    _, deviation, *_ = plain([v for _, v in rows[:4]])
    assert sorted(r._deviation for r in got) == sorted(deviation)


def test_equal_rows_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    out, w = whitening.whiten(same, "embedding", 2)
    assert len(w.values) == 0 and all(r._whitened == [] and r._deviation == 0 for r in out.collect())
    out, w = whitening.whiten(same.where("vec_id < 0"), "embedding", 2)
    assert w is None and out.count() == 0


def test_deviations_beyond_longs():
    x = np.array([[1 << 39, 0], [-(1 << 39), 1]])
    sums = [2 * 1000000, 2 * 1000000 + 1]
    assert whitening.deviations(x, 2, sums) == [None, None]
    x = np.array([[1 << 29, 0], [-(1 << 29), 1]])
    assert whitening.deviations(x, 2, sums) == [(1 << 60) + 1, (1 << 60) + 1]
