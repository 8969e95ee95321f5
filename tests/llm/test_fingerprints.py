import hashlib

from pyspark.sql import functions as F

from quaylight.llm import fingerprints as P
from quaylight.llm.common import table


def test_op2_texts_and_likeness(spark, tiny):
    rows = {r.doc_id: r for r in P.op2(spark, tiny).collect()}
    docs = sorted(((r.doc_id, r.text) for r in table(spark, tiny, "documents").collect()), reverse=True)
    for i, (d, t) in enumerate(docs):
        nxt, cut = docs[(i + 1) % len(docs)], len(t) // 3
        assert rows[d].n_chars == len(t)
        assert rows[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[1][:cut]).encode()).hexdigest()
        same = 64 - bin(int(rows[d].fingerprint, 16) ^ int(rows[nxt[0]].fingerprint, 16)).count("1")
        assert rows[d].near_next == same / 64
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)


def test_votes_against_plain_sums(spark):
    text = "some words and some more words repeat some words"
    got = P.fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first().fp
    words = text.split()
    pairs = [*zip(words, words[1:], strict=False), (words[-1], None)]
    h = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h"), F.length("a").alias("w")).collect()
    votes = [sum(r.w if r.h >> k & 1 else -r.w for r in h) for k in range(64)]
    assert got % 2**64 == sum(1 << k for k in range(64) if votes[k] > 0)


def test_within_finds_all(spark):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:3]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)) + [(99, None)], "id long, fp long")
    got = {(r.query, r.id) for r in P.within(df.withColumnRenamed("id", "query"), df, 3).collect()}
    assert got == {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if bin(a ^ b).count("1") <= 3}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.edited_likeness(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].fp == by[3].fp == by[7].fp == 0
    assert by[1].fp == by[2].fp
    assert by[6].n_chars == 8000
    assert P.edited_likeness(no_docs).count() == 0
    assert P.edited_likeness(odd_docs.where("doc_id = 6")).first().near_next == 1.0


def plain_fingerprint(spark, text):
    """Votes of weighted word pairs, counted in Python."""
    words = text.split()
    pairs = [*zip(words, words[1:], strict=False), *([(words[-1], None)] if words else [])]
    if not pairs:
        return 0
    h = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h"), F.length("a").alias("w")).collect()
    return sum(1 << k for k in range(64) if sum(r.w if r.h >> k & 1 else -r.w for r in h) > 0)


def test_edited_fingerprints_against_plain_votes(spark, tmp_path):
    texts = ["the first text of a few words", None, "a second one, somewhat longer than the first text", "x", "the first text of a few words", "last one é ü ß"]
    spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in P.op2(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        own, other, after = (plain_fingerprint(spark, x) for x in (t, edited, nxt))
        assert (rows[i * 3].fingerprint, rows[i * 3].edited_fingerprint) == (f"{own:016x}", f"{other:016x}")
        assert rows[i * 3].near_edited == 1 - (own ^ other).bit_count() / 64
        assert rows[i * 3].near_next == 1 - (own ^ after).bit_count() / 64


def test_search_against_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in P.op2(spark, tiny).select("doc_id", "fingerprint").collect()]
    by = {}
    for d, f in rows:
        by.setdefault(f, []).append(d)
    want = {
        (min(a), min(b), sum(d % 20 == 0 for d in a), len(b), (f ^ g).bit_count())
        for f, a in by.items() for g, b in by.items() if any(d % 20 == 0 for d in a) and (f ^ g).bit_count() <= 3
    }
    got = [tuple(r) for r in P.search(spark, tiny).collect()]
    assert sorted(got) == sorted(want)
    assert P.class_links(docs.limit(0), F.lit(True)).count() == 0
