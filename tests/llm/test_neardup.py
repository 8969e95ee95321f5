import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quaylight.llm import components, nearsets, neardup, sketch
from quaylight.llm.common import table


def grouped(ids, linked):
    """Smallest id reachable, by brute force over all pairs."""
    label = {i: i for i in ids}
    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and linked(a, b)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_bit_planes_find_all_within_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 30, np.uint64)
    values = np.r_[base, base ^ np.uint64(0b1011), base ^ np.uint64(1 << 63), rng.integers(0, 2**64, 100, np.uint64)]
    for radius in (0, 1, 3, 4, 7, 20):
        i, j = neardup.close(values, neardup.planes(values), len(values), radius)
        want = {(a, b) for a in range(len(values)) for b in range(len(values)) if bin(int(values[a] ^ values[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_block_tables_guarantee():
    rng = random.Random(1)
    for n in (10, 10**9, 10**12):
        tables = neardup.block_tables(n, 4)
        for _ in range(200):
            bits = set(rng.sample(range(64), 4))
            assert any(not any(a <= b < a + k for a, k in t for b in bits) for t in tables)


def test_components_of_chains_loops_and_nothing(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components.connected_components(e.where("u > 1000")).count() == 0


def test_op1_against_brute_force(spark, tiny):
    got = {r.doc_id: r for r in neardup.op1(spark, tiny).collect()}
    docs = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    fps = {d: neardup.simhash(t.encode(), 4) for d, t in docs.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == grouped(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)


def test_shingle_hash_is_sparks(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert neardup._xxh(b"a b c d") == want % 2**64


def test_chunked_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = random.Random(5)
    fps = sorted({(1 << 40) ^ (1 << rng.randrange(20, 52)) for _ in range(40)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in components.connected_components(neardup.fingerprint_links(df, 4)).collect()}
    assert set(got.values()) == {0}
    assert len(got) == len(fps)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r.component_id for r in rows}
    assert by[2] == by[5] == 1
    assert by[4] == by[7] == 3
    assert neardup.simhash_components(no_docs).count() == 0
    sim = {r.doc_id: r.component_id for r in nearsets.similar_components(odd_docs).collect()}
    assert sim == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}
    assert nearsets.similar_components(no_docs).count() == 0


def plain_shingles(text, k=5):
    """Sets of word tuples, without the operator's code."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(spark, docs):
    sets = {d: plain_shingles(t) for d, t in docs.items()}
    want = grouped(sorted(docs), lambda a, b: docs[a] == docs[b] or bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    alone = {d for d in docs if list(want.values()).count(want[d]) == 1}
    rows = list(docs.items())
    random.Random(4).shuffle(rows)
    got = {r.doc_id: r.component_id for r in nearsets.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, c in want.items() if d not in alone}
    return got


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = {i: edited(rng, base, rng.randrange(8)) for i in range(60)}
    docs |= {60: "quite another text with other words", 61: "quite another text with other words too"}
    similar(spark, docs)


def test_large_groups_lose_nothing_and_are_not_compared_twice(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "CHUNK", 8)
    monkeypatch.setattr(nearsets, "TILE", 8)
    monkeypatch.setattr(nearsets, "SAMPLE", 1)
    monkeypatch.setattr(nearsets, "PIVOTS", 3)
    rng = random.Random(12)
    docs = {}
    for n in (12, 40, 150):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        docs |= {len(docs) + i: edited(rng, base, rng.randrange(1 + n // 25)) for i in range(40)}
    common = " ".join(f"c{i}" for i in range(30))
    docs |= {200 + i: f"{common} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(20))}" for i in range(40)}
    similar(spark, docs)
    # A group whose rows share a label is in no tile.
    one = spark.createDataFrame([(1, i, 7) for i in range(100)] + [(2, i, None) for i in range(100)], "key long, doc_id long, label long").withColumn("class", F.lit(3))
    assert {r.key for r in nearsets._dealt(one, 8).select("key").distinct().collect()} == {2}


def test_short_texts_at_the_similarity_lose_no_link(spark):
    rng, docs = random.Random(9), {}
    for n in range(8, 60):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            i = len(docs)
            docs[i] = " ".join(words)
            # Without the last m // 5 of m shingles the similarity is 0.8 or a little more.
            docs[i + 1] = " ".join(words[: n - (n - 4) // 5])
    assert len(similar(spark, docs)) == len(docs)


def test_radius_loses_fewer_than_one_in_ten_billion_pairs():
    def signs(n):
        logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(n + 1)]) - n * math.log(2)
        return 2 * np.arange(n + 1) - n, np.exp(logs)

    def apart(both, a, b):
        (s, ps), (x, px), (y, py) = signs(both), signs(a), signs(b)
        p, q = (np.array([w[v > -t].sum() for t in s]) for v, w in ((x, px), (y, py)))
        return float((ps * (p * (1 - q) + (1 - p) * q)).sum())

    for both in (*range(26, 90), 150, 400):
        rest = int(both / 0.8 + 1e-9) - both
        p = max(apart(both, a, rest - a) for a in range(rest + 1))
        tail = sum(math.comb(256, i) * p**i * (1 - p) ** (256 - i) for i in range(sketch.RADIUS + 1, 257))
        assert tail < 1e-11


def test_parities_differ_in_no_more_bits_than_shingles():
    rng = random.Random(3)
    for _ in range(300):
        both, a, b = (rng.randrange(k) for k in (40, 6, 6))
        parts = [str(rng.random()).encode() for _ in range(both + a + b)]
        x, y = sketch.parity(sketch.digests(parts[: both + a])), sketch.parity(sketch.digests(parts[:both] + parts[both + a :]))
        assert sketch.distances(x, y) <= a + b


def test_voting_rule_against_plain_counts():
    text = "The quick brown fox and the quick brown fox and the lazy Dog"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert neardup.simhash(text.encode(), 4) == want


def test_ids_of_any_size_and_none(spark):
    rows = [(2**63 - 1, "one text of some words"), (2**62 + 5, "one text of some words"), (-(2**63), "quite another text here"), (None, "a third text without an id"), (None, "one text of some words")]
    got = neardup.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2**63 - 1, 2**62 + 5), (2**62 + 5, 2**62 + 5), (-(2**63), -(2**63)), (None, None), (None, 2**62 + 5)}


def test_one_id_with_two_texts_has_the_links_of_both(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "p q r s t u v w x y"), (9, "p q r s t u v w x y"), (9, "nothing like the others at all")]
    got = {r.doc_id: r.component_id for r in nearsets.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 9: 1}


def test_keep_one_judges_rows_by_their_own_text(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "nothing like the others at all"), (None, "a b c d e f g"), (7, "twice the same row of words"), (7, "twice the same row of words"), (9, None), (8, ""), (6, "p q r s t u")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _n int, component_id int")
    kept = nearsets.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, "A b c d e f g"), (3, "nothing like the others at all"), (7, "twice the same row of words"), (8, ""), (6, "p q r s t u")])
    one = df.where("doc_id IN (5, 6, 8)")
    assert sorted(r.doc_id for r in nearsets.keep_one(one.union(one.where("doc_id = 5").withColumn("doc_id", F.lit(4)))).collect()) == [4, 6, 8]
    assert nearsets.keep_one(df.limit(0)).count() == 0
