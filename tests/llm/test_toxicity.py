import pytest

from quaylight.llm import toxicity as T
from quaylight.llm.common import table


def test_noisy_or_and_sentences():
    m = T.Model(-2.0, {"=bad": 4.0})
    p = [m.sentence(s) for s in T.sentences("fine words. bad words! more")]
    assert m.score("fine words. bad words! more") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))
    assert p[1] > 0.8 > 0.2 > p[0]
    assert m.score("") == pytest.approx(m.sentence(""))
    assert m.score("bad " * 50) == pytest.approx(m.sentence("bad"))


def test_learns_which_sentence_offends():
    good = [f"word{i} is here. nothing to see{i % 7}. more text." for i in range(120)]
    bad = [f"word{i} is here. you are an idiot. more text." for i in range(120, 180)]
    m = T.fit(good + bad, [0] * len(good) + [1] * len(bad))
    assert m.score("A new text. What an idiot! The end.") > 0.7
    assert m.score("A new text. The end.") < 0.3
    assert m.sentence("what an idiot") > 10 * m.sentence("more text")


def test_one_label_or_none():
    assert T.fit([], []).score("x") < 0.01
    assert T.fit(["a"], [0]).score("x") < 0.01
    assert T.fit(["a"], [1]).score("x") > 0.99


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in T.op8(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [d for d in labels if rows[d].held_out]
    hit = sum(rows[d].predicted for d in held if labels[d])
    assert hit >= 0.8 * sum(labels[d] for d in held)
    assert sum(rows[d].predicted for d in held if not labels[d]) <= 0.01 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_odd_rows(spark, odd_docs, no_docs):
    m = T.Model(-3.0, {"=one": 9.0})
    wide = odd_docs.withColumn("_score", T.F.lit("mine")).withColumn("_text", T.F.lit(1))
    for keep in (["doc_id", "fp"], wide.columns):
        out = T.score(wide, m, keep).collect()
        assert len(out) == odd_docs.count()
        assert {r._row.doc_id for r in out if r._score > 0.9} == {1, 2, 5}
    assert {r.doc_id for r in T.locate(odd_docs, m, 0.9).collect()} == {1, 2, 5}
    assert T.score(no_docs, m, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(1, 1), (8, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert isinstance(T.train(odd_docs, labels, T.F.lit(True)), T.Model)
