import hashlib
import random

import numpy as np

from quaylight.llm import substrings as S
from quaylight.llm.common import table


def brute(rows):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0]):
        for p in range(len(t) - S.SPAN + 1):
            first.setdefault(t[p : p + S.SPAN], 2**63 if d is None else d)
    for d, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - S.SPAN + 1):
            if first[t[p : p + S.SPAN]] < (2**63 if d is None else d):
                gone[p : p + S.SPAN] = b"\1" * S.SPAN
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.setdefault(d, set()).add((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df):
    got = {}
    for r in S.remove_repeats(df).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed
    assert got == brute([(r.doc_id, (r.text or "").encode()) for r in df.collect()])


def test_small_table(spark, tiny):
    check(table(spark, tiny, "documents").select("doc_id", "text"))


def test_edges_runs_and_odd_rows(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcde ") for _ in range(900))
    rows = []
    for i in range(60):
        x, y = rng.randrange(700), rng.randrange(30, 200)
        rows.append((i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(60))) + base[x : x + y] + "q" * rng.randrange(5) + base[x + 10 : x + 10 + y // 2] + "a" * rng.choice([0, 49, 50, 51, 200])))
    rows += [(60, None), (61, ""), (62, "é" * 60), (63, "é" * 70), (64, base), (65, base), (65, base[5:]), (None, base), (None, base[3:])]
    check(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, run int").repartition(5))


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(S, "PIECE", 700)
    texts = [base.encode(), ("zz" + base[100:] + "y").encode(), b"short"]
    seen = [set(), set(), set()]
    for b, starts, placed in S._pieces(texts):
        a, first, last, _, run, _ = S._anchors(b, starts)
        for k, f, z in zip(S._owners(placed, first), first, last, strict=True):
            doc, offset, place = placed[k]
            for p in range(int(f), int(z) + 1):
                assert b[p : p + 50].tobytes() == texts[doc][p - place + offset : p - place + offset + 50]
                assert p - place + offset not in seen[doc]
                seen[doc].add(p - place + offset)
    assert [len(s) for s in seen] == [max(0, len(t) - 49) for t in texts]


def test_suffix_buckets_against_sorting(monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 50)
    rng = np.random.default_rng(5)
    unit = rng.integers(97, 99, 70).astype(np.uint8)
    text = np.concatenate([unit, rng.integers(97, 99, 630).astype(np.uint8), unit, np.full(140, 97, np.uint8)])
    at = np.arange(0, len(text) - S.SPAN, S.PERIOD)
    groups = {}
    for own, group in S.equal_strings(text, at):
        part = [text[p : p + S.SPAN].tobytes() for p in at[own]]
        assert part == sorted(part)
        for p, g in zip(part, group.tolist(), strict=True):
            groups.setdefault(p, set()).add((id(own), g))
    assert all(len(g) == 1 for g in groups.values())
    assert len({x for g in groups.values() for x in g}) == len(groups)


def test_no_rows(spark, no_docs):
    assert S.remove_repeats(no_docs).count() == 0


def test_frequent_grams_in_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "SAMPLE", 1)
    rng = random.Random(8)
    base = "".join(rng.choice("abcde ") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(80))) + base[rng.randrange(60) :] + str(rng.random()) * rng.randrange(4)) for i in range(40)]
    rows += [(100, base), (101, base), (101, base), (None, base), (102, "f" * 300), (102, "f" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = df.selectExpr("coalesce(doc_id, 9223372036854775807) AS doc", "cast(text AS binary) AS data")
    assert S._frequent_grams(own).count() > 3
    check(df)
