import random
from collections import Counter

import numpy as np

from quaylight.llm import decontaminate as D
from quaylight.llm.common import table
from quaylight.llm.sketch import pack


def brute(docs, items, like=D.LIKE):
    out = {}
    for d, t in docs:
        w = D.words_of(t or "")
        for i, x in items:
            own = D.words_of(x or "")
            k, n = min(D.SHINGLE, len(own)), min(len(own), len(w))
            if not own or not w or n < k:
                continue
            bag = Counter(D.shingles(own, k))
            best = max(D.similarity(bag, Counter(D.shingles(w[s : s + n], k))) for s in range(len(w) - n + 1))
            if best >= like - 1e-12:
                out[d, i] = round(best, 9)
    return out


def test_op9_against_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in table(spark, tiny, "documents").collect() if len(r.text) < 6000]
    items = [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()]
    ids = {d for d, _ in docs}
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.op9(spark, tiny).collect() if r.doc_id in ids}
    assert got == brute(docs, items)
    assert got


def test_near_windows_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    words = [f"term{i}" for i in range(60)]
    items = [(1, " ".join(words)), (2, None), (3, "..."), (4, "one two three four five six"), (5, "é à"), (6, " ".join(words[:30]))]
    texts = [" ".join(["lead"] * 7 + words + ["tail"]), " ".join(words[:58] + ["x", "y"]), " ".join(words[::-1]), " ".join(words[:20] + ["z"] + words[20:]), " ".join(words[:40])]
    docs = [(100 + i, t) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    both = docs + [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").collect()]
    df = spark.createDataFrame(both, "doc_id long, text string")
    want = brute(both, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(df, bench).collect()} == want
    monkeypatch.setattr(D, "ITEMS", 2)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(df, bench).collect()} == want
    assert D.contaminated(no_docs, bench).count() == 0
    assert D.contaminated(df, bench.where("item_id > 99")).count() == 0


def test_short_windows_at_the_similarity_lose_no_match(spark):
    rng, items, docs = random.Random(6), [], []
    for n in range(5, 60):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            items.append((len(items), " ".join(words)))
            # As many words less as keep the similarity at 0.8 or above; or some others at the end.
            docs.append((len(docs), " ".join(words[: n - (n - 4) // 5])))
            docs.append((len(docs), " ".join(["lead", *words[: n - (n - 4) // 9], *(f"x{i}" for i in range(9)), "tail"])))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_same(docs, items)
    assert len(want) > len(items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(df, bench).collect()} == want


def brute_same(docs, items):
    """As ``brute``, for items that share no words: only the item of a document is tried."""
    out = {}
    for d, t in docs:
        out |= brute([(d, t)], [items[d // 2]])
    return out


def test_repeated_shingles(spark):
    line = "the same line of words again and "
    items = [(1, line * 6), (2, line * 12 + "end"), (3, "buy " * 50), (4, "buy " * 45 + "sell now")]
    docs = [(1, "first " + line * 6), (2, line * 11), (3, "buy " * 47), (4, line * 3), (5, "buy " * 10), (6, ("word " + line) * 6)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, items)
    assert want
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(df, bench).collect()} == want


def test_blocks_give_all_within_the_radius():
    rng = np.random.default_rng(8)
    x = D.Lengths(40, 5, 0.8)
    for i in range(50):
        x.add(i, [f"p{i} {j}" for j in range(36)])
    x.done()
    fps = np.concatenate([x.simhash ^ pack((rng.random((50, 256)) < p).astype(np.uint8)) for p in (0.05, 0.2, 0.3, 0.34, 0.5)])
    got = {(w, i) for i, windows in x.within(fps, 36) for w in windows.tolist()}
    want = {(a, b) for a in range(len(fps)) for b in range(50) if int(np.bitwise_count(fps[a] ^ x.simhash[b]).sum()) <= 84}
    assert got == want


def test_clean_keeps_rows_by_their_own_text(spark):
    rows = [(1, "one two three four five six", 1, 2), (1, "an innocent text", 3, 4), (None, None, 5, 6), (2, "one two three four five six", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int, item_id int")
    bench = spark.createDataFrame([(4, "one two three four five six")], "item_id long, text string")
    assert sorted(r._text for r in D.clean(df.withColumnRenamed("item_id", "similarity"), bench).collect()) == [3, 5]
    assert D.clean(df, bench).columns == df.columns


def test_near_equal_items_in_tiles(monkeypatch):
    """Items that differ in one word each, a text full of them, more of both than a tile holds."""
    monkeypatch.setattr(D, "ITEM_TILE", 16)
    monkeypatch.setattr(D, "WINDOW_TILE", 64)
    monkeypatch.setattr(D, "STRETCH", 100)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join([*words[: i % 60], f"other{i}", *words[i % 60 + 1 :]])) for i in range(90)]
    text = " ".join(w if rng.random() > 0.02 else "x" for _ in range(8) for w in [*words, *words[:20]])
    got = {(7, i): round(like, 9) for i, like, _, _ in D.Items(items).matches(text)}
    assert got == brute([(7, text)], items)
    assert len(got) == 90


def test_shared_counts_of_all_windows():
    rng = random.Random(3)
    for window in (1, 4, 9):
        parts = [rng.choice("abcdef") for _ in range(40)]
        bag = Counter(rng.choice("abcxyz") for _ in range(12))
        got = D.Run(parts, window).shared(bag).tolist()
        assert got == [sum((Counter(parts[s : s + window]) & bag).values()) for s in range(len(parts) - window + 1)]
