import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quaylight.llm import neighbours


def brute(ids, x, asked, top):
    """{query: [(vec_id, score)]} by all products, nearest first, ties to the smaller id."""
    scores = x[asked] @ x.T
    out = {}
    for i, row in zip(asked, scores, strict=True):
        order = [j for j in np.lexsort((ids, -row)) if j != i][:top]
        out[int(ids[i])] = [(int(ids[j]), row[j]) for j in order]
    return out


def check(rows, want, recall, x, ids):
    at, hit, total = {int(v): i for i, v in enumerate(ids)}, 0, 0
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in want.items():
        own = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(found) + 1))
        order = [(-r.score, r.vec_id) for r in own]
        assert order == sorted(order) and len({r.vec_id for r in own}) == len(own)
        for r in own:
            assert r.vec_id != q and r.score == pytest.approx(float(x[at[q]] @ x[at[r.vec_id]]), rel=1e-12, abs=1e-12)
        hit += len({r.vec_id for r in own} & {v for v, _ in found})
        total += len(found)
    assert hit >= recall * total


def test_op11(spark, tiny):
    t = pq.read_table(f"{tiny}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64)
    check(neighbours.op11(spark, tiny).collect(), brute(ids, x, np.flatnonzero(ids % 20 == 0), 20), 0.93, x, ids)


@pytest.fixture(scope="module")
def clusters():
    """6,000 vectors about 60 places, of lengths from 0.2 to 5 and a few of 100."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)] + 0.4 * rng.standard_normal((6000, 24))
    x *= (rng.uniform(0.2, 5, 6000) / np.linalg.norm(x, axis=1))[:, None]
    x[:3] *= (100 / np.linalg.norm(x[:3], axis=1))[:, None]
    return np.arange(6000), x


def test_recall_over_lengths_and_blocks(spark, clusters, monkeypatch):
    """Lists of one group in several blocks, and vectors of very different lengths."""
    ids, x = clusters
    monkeypatch.setattr(neighbours, "BLOCK", 8 * 24 * 300)
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(6)
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, 10)
    check(found.rows.collect(), brute(ids, x, np.flatnonzero(ids % 20 == 0), 10), 0.92, x, ids)


def test_index_parts_and_graph(clusters):
    _, x = clusters
    x = x / np.linalg.norm(x, axis=1)[:, None]
    bands = neighbours.fit(x[::2], len(x), 1.0 + 1e-9)
    band = bands[0]
    assert len(band.centroids) > 40 and [len(b.centroids) for b in bands[1:]] == [1] * (neighbours.BANDS - 1)
    lifted = neighbours.lift(x, band.long)
    far = np.linalg.norm(lifted[:, None] - band.centroids, axis=2)
    entered = neighbours.entered(band, lifted)
    assert np.mean([far[i].argmin() in e for i, e in enumerate(entered)]) > 0.97
    sizes = np.bincount(np.concatenate(entered))
    assert sizes.max() <= 5 * sizes.mean() and max(map(len, entered)) > 1
    seen = neighbours.visited(band, lifted[:200], 1.3)
    assert np.allclose(seen[np.isfinite(seen)], far[:200][np.isfinite(seen)], atol=1e-3)
    want = far[:200] <= 1.3 * neighbours.reach(far[:200], band.long)
    assert (np.isfinite(seen) & want).sum() > 0.97 * want.sum()


def test_copies_ties_and_odd_vectors(spark):
    """A vector that recurs 1,000 times, repeated rows, and what takes no part."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(1000)] + [(2000 + i, [0.5, i / 100]) for i in range(40)] + [(20, [1.0, 0.0])] * 30
    odd = [(3000, None), (3020, [0.0, 0.0]), (3040, [nan, 1.0]), (3060, [inf, 1.0]), (3080, [None, 1.0]), (3100, [1.0]), (3120, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, id int, lists int").repartition(5)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, 20, 1.0).rows.collect()
    ids = np.array(sorted({i for i, _ in rows}))
    by = dict(rows)
    x = np.array([by[i] for i in ids])
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, k + 1, v, s) for q, found in want.items() for k, (v, s) in enumerate(found)}
    assert len(got) == 20 * len(want)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<float>")
    ask = lambda d: sorted(map(tuple, neighbours.search(d, F.col("vec_id") % 20 == 0).rows.collect()))
    assert ask(df) == [(0, 1, 7, 2.0)]
    assert ask(df.where("vec_id = 0")) == ask(df.where("vec_id = 7")) == ask(df.where("vec_id < 0")) == []
