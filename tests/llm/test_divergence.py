import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same

from quaylight.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, bound=10, top=10):
    """The audit of (text, lang, source) rows by counting everything, over all kept terms."""
    rows = [tuple(x or "" for x in r) for r in rows]
    frequency, counts, langs = Counter(), defaultdict(Counter), defaultdict(set)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang, source in rows:
        found = [t.translate(lower) for t in TERM.findall(text)]
        frequency.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for (own, t), n in frequency.items() if own == lang and n >= bound]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            far = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            high = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            for part, found in (("pair", far), ("term", high[:top])):
                out |= {(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)}
    return out


def test_op13(spark, tiny):
    assert_same(divergence.op13(spark, tiny), divergence.OP13_SQL, tiny)


def test_op13_by_counting(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("text", "lang", "source")
    assert {tuple(r) for r in divergence.op13(spark, tiny).collect()} == plain([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("bound", [1, 2, 300])
def test_odd_rows(spark, bound):
    rows = [("Ab ab é\x00É x1y", "a", "s"), ("ab ab zz", "a", "t"), (None, "a", "empty"), ("ab", None, None), ("", "", "u"), ("zz ß ab", "b", "only"), ("123 !", "c", "v"), ("", "c", "w"), ("ab 𝒳𝒳 zz", "a", "t")]
    rows += [("ab ab zz", "a", "t")] * 3 + [("q " * 70000, "a", "hot"), ("ab qq", "a", "hot")] * 2
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, term int, p int, count int").repartition(3)
    assert {tuple(r) for r in divergence.audit(df, bound=bound, top=2).collect()} == plain(rows, bound, 2)


def test_no_rows(spark, no_docs):
    out = divergence.audit(no_docs)
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def lettered(i):
    return "".join(chr(97 + int(d)) for d in str(i))


def spots(words, width):
    """Counters of words of language l, in the order of ``words``."""
    found = divergence.Counts([("l",)], pa.array([" ".join(words)]))
    at = dict(zip((found.words[int(w)].as_py() for w in found.word), found.spots(0, width).T, strict=True))
    return np.array([at[w] for w in words]).T


def test_the_sketch_never_underestimates_and_discards(spark):
    """40,000 rare terms and 50 frequent ones, over as many counters and over far fewer."""
    rare = [[f"r{lettered(i)}x{lettered(j)}" for j in range(20)] for i in range(2000)]
    frequent = [f"f{lettered(i)}" for i in range(50)]
    docs = spark.createDataFrame([("l", " ".join([*own, frequent[i % 50]])) for i, own in enumerate(rare)], "lang string, text string").repartition(4)
    every = [w for own in rare for w in own]
    for width, passed in ((1 << 16, 0.01), (1 << 10, 1.0)):
        found = divergence.sketch(docs, "lang", "text", 10, width)
        assert found.possible(spots(frequent, width)).all()
        assert found.possible(spots(every, width)).mean() <= passed


def test_rare_terms_are_not_shuffled(spark):
    docs = [(f"all of these words rare{lettered(i)} seldom{lettered(i)}", "l", "s" if i % 3 else "t") for i in range(60)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    known = spark.sparkContext.broadcast(divergence.sketch(df, "lang", "text", 10, 1 << 16))
    out = df.select("lang", "source", "text").mapInArrow(lambda b: divergence._survivors(known, b), "lang string, source string, term string, count long, docs long")
    assert {r.term for r in out.collect()} == {"all", "of", "these", "words"}


def test_terms_of_a_column():
    texts = ["Ab", "cD e1f", "", "é\x00É", "\n", "z"]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    rows, words = divergence.terms(column)
    assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == [(0, "ab"), (1, "cd"), (1, "e"), (1, "f"), (3, "é"), (3, "É"), (5, "z")]
    assert divergence.terms(pa.array(["", ""]))[1].to_pylist() == []
