import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from quaylight.operators import blocks, classify
from quaylight.plans import catalogue


def plain_projection(parts, k, cross=60.0):
    """Block by block, padded to one width, as written down for tensors."""
    p, wide = len(parts), max(x.shape[1] for x in parts)
    gram = np.zeros((p * wide, p * wide))
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            m = np.round((1 / p if i == j else cross) * a.T @ b, 2)
            gram[i * wide : i * wide + m.shape[0], j * wide : j * wide + m.shape[1]] = m
    values, vectors = np.linalg.eigh(gram)
    top = vectors[:, np.argsort(-values)[:k]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    return np.round(sum(x @ top[i * wide : i * wide + x.shape[1]] for i, x in enumerate(parts)) / p, 4)


def test_three_blocks_of_unlike_widths(spark):
    rng = np.random.default_rng(2)
    parts = [rng.standard_normal((80, d)) * s for d, s in ((5, 1.0), (3, 2.0), (7, 0.5))]
    tables = [spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], f"id long, b{n} array<double>").repartition(4) for n, x in enumerate(parts)]
    out = blocks.multi_set_projection(blocks.aligned(tables, "id"), "id", ["b0", "b1", "b2"], 4)
    got = np.array([r.projected for r in out.orderBy("id").collect()])
    assert np.abs(got - plain_projection(parts, 4)).max() < 2e-4


def test_block_projection_of_the_embeddings(spark, tiny):
    t = pq.read_table(f"{tiny}/embeddings.parquet").sort_by("vec_id")
    x = np.array(t["embedding"].to_pylist(), float)
    half = x.shape[1] // 2
    hot = np.eye(10)[np.array(t["label"])]
    got = np.array([r.projected for r in catalogue.QUERIES["block_projection"](spark, tiny).orderBy("vec_id").collect()])
    assert np.abs(got - plain_projection([x[:, :half], x[:, half:], hot], 8)).max() < 2e-4


def test_odd_blocks(spark):
    rows = [(1, [1.0, 2.0], [3.0]), (2, None, [1.0]), (3, [1.0], [None]), (4, [], []), (None, [2.0, 2.0], [2.0])]
    df = spark.createDataFrame(rows, "i long, projected array<double>, _key array<double>")
    whole = [(i, [*(a or []), 0, 0][:2], [*[v or 0 for v in b], 0][:1]) for i, a, b in rows]
    parts = [np.array([r[1] for r in whole], float), np.array([r[2] for r in whole], float)]
    renamed = df.toDF("i", "a", "b")
    got = {r.i: r.projected for r in blocks.multi_set_projection(renamed, "i", ["a", "b"], 9).collect()}
    want = plain_projection(parts, 3)
    assert all(np.abs(np.array(got[r[0]]) - w).max() < 2e-4 for r, w in zip(rows, want, strict=True))
    assert blocks.multi_set_projection(renamed.where("i > 9"), "i", ["a", "b"], 2).count() == 0
    assert [r.projected for r in blocks.multi_set_projection(renamed.where("i = 4"), "i", ["a", "b"], 2).collect()] == [[]]


def plain_posteriors(texts, labels):
    counts = {c: Counter(w for t, x in zip(texts, labels, strict=True) if x == c for w in t) for c in set(labels)}
    kinds = len({w for t in texts for w in t})
    out = []
    for t in texts:
        s = {c: math.log(labels.count(c) / len(labels)) + sum(math.log((n[w] + 1) / (sum(n.values()) + kinds)) for w in t) for c, n in counts.items()}
        top = max(s.values())
        total = sum(math.exp(v - top) for v in s.values())
        out.append({c: math.exp(v - top) / total for c, v in s.items()})
    return out


def test_posteriors_and_best_labels(spark):
    texts = [["a", "b", "a"], ["b", "c"], ["c", "c", "d"], [], ["a"], ["d", "a", "b"]]
    labels = ["x", "y", "y", "z", "x", "y"]
    docs = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    flat = [(i, w, n) for i, t in enumerate(texts) for w, n in Counter(t).items()]
    terms = spark.createDataFrame(flat, "i int, term string, tf long")
    counts = classify.class_counts(terms.join(docs, "i"), "label")
    found = classify.posteriors(docs, terms, counts, classify.classes(docs, counts, "label"), "i", "label")
    got = {(r.i, r.label): r.p for r in found.collect()}
    want = {(i, c): p for i, own in enumerate(plain_posteriors(texts, labels)) for c, p in own.items()}
    assert got == pytest.approx(want)
    names = spark.createDataFrame([("x", "Ex")], "label string, name string")
    best = {(r.i, r["rank"]): r.name for r in classify.best_labels(found, "i", "label", names, 2, 0.3).collect()}
    for i in range(len(texts)):
        own = sorted(((-p, c) for (d, c), p in want.items() if d == i and p > 0.3))[:2]
        assert [best.get((i, r + 1)) for r in range(len(own))] == [{"x": "Ex"}.get(c, c) for _, c in own]
    assert len(best) == sum(min(2, sum(p > 0.3 for (d, _), p in want.items() if d == i)) for i in range(len(texts)))


def test_a_text_of_unknown_terms_has_the_prior(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "i int, label string")
    counts = spark.createDataFrame([("x", "a", 3), ("y", "b", 3)], "label string, term string, n long")
    terms = spark.createDataFrame([(1, "q", 400)], "i int, term string, tf long")
    found = classify.posteriors(docs, terms, counts, classify.classes(docs, counts, "label"), "i", "label").collect()
    assert {(r.i, r.label): round(r.p, 9) for r in found} == {(1, "x"): 0.5, (1, "y"): 0.5, (2, "x"): 0.5, (2, "y"): 0.5}


def test_languages_of_documents_that_no_profile_has_seen(spark, tiny):
    rows = catalogue.QUERIES["detected_language"](spark, tiny).collect()
    right, n = sum(r.n for r in rows if r.lang == r.detected), sum(r.n for r in rows)
    assert n == spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert right > 0.95 * n


def test_posteriors_do_not_multiply_postings(spark, monkeypatch):
    """A posting meets one row, whatever the number of classes; many classes give the same."""
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(9)], "i int, label string")
    terms = spark.createDataFrame([(i, t, 1 + i % 2) for i in range(8) for t in ("x", "y", f"t{i % 4}")], "i int, term string, tf int")
    counts = classify.class_counts(terms.where("i < 7").join(docs, "i"), "label")
    found = lambda: classify.posteriors(docs, terms, counts, classify.classes(docs, counts, "label"), "i", "label")
    wide = found()
    assert "Expand" not in (plan := wide._jdf.queryExecution().optimizedPlan().toString()) and "_label" not in plan
    got = sorted((r.i, r.label or "", round(r.p, 9)) for r in wide.collect())
    monkeypatch.setattr(classify, "WIDE", 0)
    assert got == sorted((r.i, r.label or "", round(r.p, 9)) for r in found().collect()) and len(got) == 36
