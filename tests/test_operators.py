import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.functions import numbers as N
from quaylight.functions import stem
from quaylight.functions import text as X
from quaylight.operators import formula, geometry, learn, parse, ranking, relational, sampling, series, web
from quaylight.operators import textsearch as TS
from quaylight.sources import fetch, io
from quaylight.streaming import events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_load_formats_and_view(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "K int, v string")
    for fmt in ("orc", "parquet", "csv"):
        io.save(df, str(tmp_path / fmt), fmt=fmt, header=True)
        assert io.load(spark, f"{fmt}://{tmp_path / fmt}", {"header": "true"}, view="loaded").count() == 2
    assert spark.sql("SELECT count(*) AS n FROM loaded").first().n == 2
    assert io.lower_columns(df).columns == ["k", "v"]
    with pytest.raises(Exception, match="EXISTS"):
        io.save(df, str(tmp_path / "orc"), fmt="orc")


def test_tsv_sink_and_index(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tB\n1\tx\n1\tx\n\ty\n")
    assert io.read_tsv(spark, str(tmp_path / "a.tsv"), ["id", "site"]).count() == 1
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "doc int, tokens array<string>")
    io.save_index(docs, str(tmp_path / "ix"), "doc", "tokens")
    assert {(r.term, r.df) for r in spark.read.parquet(str(tmp_path / "ix/terms")).collect()} == {("a", 1), ("b", 2)}


def test_gapless_ids_with_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(5,), (1,), (None,), (5,), (3,)], "k long")
    got = sorted((r.i, r.k) for r in relational.gapless_ids(df, "k", "i", 10, parts=3).collect())
    assert got == [(10, 1), (11, 3), (12, 5), (13, 5), (14, None)]
    assert relational.gapless_ids(df.where("k > 9"), "k").count() == 0


def test_latest_wins_puts_null_dates_last(spark):
    df = spark.createDataFrame([(1, 2, None, "a"), (1, 2, "2020", "b"), (1, 1, "2021", "c")], "e int, prio int, d string, v string")
    assert [r.v for r in relational.first_by(df, ["e"], [F.struct("prio", "d").desc()]).collect()] == ["b"]


def test_nearest_year_skips_zero_null_and_old(spark):
    b = spark.createDataFrame([("p", "b", 2014, 1.0)], "peer string, base string, year int, val double")
    p = spark.createDataFrame([("p", 2013, 5.0), ("p", 2015, 6.0), ("p", 2014, 0.0), ("p", 2014, None), ("p", 2000, 1.0)], "peer string, year int, val double")
    r = relational.nearest_year(b, p, ["peer"], 2010).first()
    assert (r.peer_year, r.peer_val) == (2013, 5.0)


def test_text_expressions(spark):
    assert one(spark, X.clean_text, "Ab-c\n1 d") == "ab c d"
    assert one(spark, X.tokens, None) == []
    assert one(spark, lambda c: X.ngrams(X.tokens(c)), "this company sells pizzas in new york") == ["this company", "company sells", "sells pizzas", "pizzas in", "in new", "new york"]
    assert one(spark, lambda c: X.ngrams(X.tokens(c)), "one") == []
    assert one(spark, X.plain_name, "Société-Générale!") == "societegenerale"
    assert one(spark, lambda c: X.first_sentences(c, 2), "A b. C d! E f?") == "A b. C d!"
    assert one(spark, lambda c: X.positional_match(c, F.lit("abd")), "abc") == pytest.approx(2 / 3)
    assert one(spark, lambda c: X.positional_match(c, F.lit("")), "abc") is None
    assert tuple(one(spark, X.money_range, "2m-5m")) == (2e6, 5e6)
    assert tuple(one(spark, X.money_range, "3k")) == (300.0, 30000.0)
    assert one(spark, X.clean_keyword, "It's a: big-deal!") == "it's big deal"
    assert one(spark, X.subsidiary_of, "We sell. It is a subsidiary of Acme Ltd, a maker.") == "Acme Ltd"
    assert one(spark, X.who_we_are, "# About us\n\nWe make tools.\n") is None
    assert one(spark, X.who_we_are, "x\n## ABOUT us\n\nWe make tools\nof steel and brass.\n\n# Overview\n* a list of six or more words\n") == "We make tools of steel and brass."
    assert one(spark, X.who_we_are, "# Mission\n# What we do\nis to make many good tools\n\n# Who we are\nshort") == "What we do is to make many good tools"
    assert one(spark, lambda c: X.pattern_is(c, F.lit("Acme")), "Acme Inc. is a maker of very fine tools. More") == "Acme Inc. is a maker of very fine tools."
    assert one(spark, lambda c: X.pattern_is(c, F.lit("Acme")), "Acme is a firm that is in the U.S. and\nothers. Z") == "Acme is a firm that is in the U.S. and others."
    assert one(spark, lambda c: X.pattern_is(c, F.lit("Acme")), "See Acme is a maker of very * fine tools") == "Acme is a maker of very "
    assert one(spark, lambda c: X.pattern_is(c, F.lit("Acme")), "Acme makes, as everybody in town knows, what is good.") is None
    assert one(spark, lambda c: X.unfold_lines(X.fold_lines(c)), "a\nb") == "a\nb"
    for text in ("þ", "þ0\nþ1", "\n\nþþ0", "10þ", ""):
        assert one(spark, lambda c: X.unfold_lines(X.fold_lines(c)), text) == text
    assert one(spark, X.html_text, "<p>a &amp; <b>b</b></p><script>x</script>") == "a & b"
    assert one(spark, X.language, "la maison est dans les bois") == "fr"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formalize", "formal"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("is", "is")])
def test_stem(word, want):
    assert stem.stem(word) == want


def test_number_expressions(spark):
    q = [1.0, 10.0]
    got = [one(spark, lambda c: N.quantise(c, q), v, "double") for v in (None, -20.0, -10.0, 0.0, 1.0, 99.0)]
    assert got == [1, 2, 3, 5, 6, 7]
    assert one(spark, lambda c: N.dequantise(N.quantise(c, q), q), 5.0, "double") == "1.0000 - 10.0000"
    assert one(spark, lambda c: N.symmetric_ratio(c, F.lit(4.0)), 2.0, "double") == 0.5
    assert one(spark, lambda c: N.symmetric_ratio(c, F.lit(4.0)), None, "double") == 0
    assert one(spark, lambda c: N.log_window(c, F.lit(1.0), 1.0), 10.0, "double") == 0  # the edge is outside
    assert one(spark, lambda c: N.ratio(F.lit(1.0), c), 0.0, "double") is None
    assert one(spark, lambda c: N.cosine(F.array(c, c), F.array(F.lit(0.0), F.lit(0.0))), 1.0, "double") is None


def test_idf_kinds(spark):
    r = spark.range(1).select(*(TS.idf(k, F.lit(3), F.lit(7), F.lit(11)).alias(k) for k in "abcd")).first()
    assert r.asDict() == pytest.approx({"a": math.log(2), "b": math.log(7 / 4), "c": math.log(7 / 3), "d": math.log(3)})


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("t", i, r) for i, r in enumerate([0, 1, 0, 2])] + [("n", i, 0) for i in range(3)], "t string, i int, rel int")
    ap = {r.t: r.ap for r in ranking.average_precision(df, ["t"], "rel", [F.col("i")]).collect()}
    assert ap == {"t": 0.5, "n": 0.0}
    nd = {r.t: r.ndcg for r in ranking.ndcg(df, ["t"], "rel", [F.col("i")], "i").collect()}
    assert nd["n"] is None
    assert 0 < nd["t"] < 1


def test_preferences_and_inversions_against_pairs(spark):
    random.seed(4)
    rows = [(random.randint(0, 2), i, random.randint(0, 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, i int, rel int")
    got = {(r.better, r.worse) for r in ranking.preferences(df, ["t"], "i", "rel").collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] > b[2]}
    inv = {r.t: (r.concordant, r.discordant) for r in ranking.inversion_counts(df, ["t"], "rel", [F.col("i")]).collect()}
    for t in range(3):
        own = [r for r in rows if r[0] == t]
        assert inv[t] == (sum(a[1] < b[1] and a[2] > b[2] for a in own for b in own), sum(a[1] < b[1] and a[2] < b[2] for a in own for b in own))


def test_krippendorff_of_perfect_agreement_is_one(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(6) for _ in range(2)], "item int, v int")
    assert ranking.krippendorff(df, "item", "v").first().alpha == 1.0


def test_growth_and_frames(spark):
    df = spark.createDataFrame([("a", 2000, 10.0), ("a", 2001, 15.0), ("a", 2002, 0.0), ("a", 2003, 7.0)], "e string, year int, val double")
    g = {r.year: r.growth for r in series.growth(df, ["e"]).collect()}
    assert (g[2001], g[2002]) == (0.5, -1.0)
    assert series.exact_frame(df, "e", 2000, 2003).count() == 1
    assert series.exact_frame(df, "e", 2000, 2002).count() == 0


def test_sampling_is_stable_and_meets_quotas(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 990, "a").otherwise("b")).withColumn("g", F.col("id") % 3)
    quotas = spark.createDataFrame([("a", 20), ("b", 20)], "s string, quota int")
    first = sampling.quota(df, "s", ["g"], "id", quotas)
    assert {r.s for r in first.collect()} == {"a"}
    assert first.count() == 20
    assert sorted(r.id for r in first.collect()) == sorted(r.id for r in sampling.quota(df, "s", ["g"], "id", quotas).collect())
    split = df.select(sampling.split_name(F.col("id"), {"x": 50, "y": 50}).alias("p")).groupBy("p").count().collect()
    assert {r.p for r in split} == {"x", "y"}
    assert spark.range(1).select(sampling.some_of(F.array(F.lit(1)), 2, 1).alias("a")).first().a == []


def test_formula_tree(spark):
    forms = {"r": 'vals("a") / vals("b")', "b": 'default(vals("c"), 0) + vals("d")'}
    assert formula.inputs(forms["b"]) == {"c": True, "d": False}
    assert formula.levels(forms, "r") == [["a", "c", "d"], ["b"], ["r"]]
    facts = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a"), (3, "r"), (4, "a"), (4, "c")], "e int, m string")
    got = {r.e: r.available for r in formula.availability(facts, forms, "r", ["e"], "m").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}
    loose = {r.e: r.available for r in formula.availability(facts, forms, "r", ["e"], "m", share=0.0).collect()}
    assert set(loose.values()) == {1}
    with pytest.raises(ValueError, match="itself"):
        formula.levels({"a": 'vals("a")'}, "a")


def test_free_text_queries(spark):
    q = parse.parse("real estate companies in Germany with at least 5 employees and between 7 and 90 revenue", ["Germany", "France"], ["Europe"])
    assert q == parse.Query("real estate companies", None, "Germany", {"numEmployees": [("gte", 5.0)], "revenue": [("gte", 7.0), ("lte", 90.0)]})
    with pytest.raises(ValueError, match="country"):
        parse.parse("firms in Germany and France", ["Germany", "France"], [])
    assert parse.canonical("no less than 5, more than 6") == "gte 5, gt 6"
    df = spark.createDataFrame([("Germany", "tools", 5.0), ("France", "tools", 50.0)], "c string, t string, r double")
    cols = {"country": "c", "text": "t", "revenue": "r"}
    assert parse.search(df, "tools with over 10 revenue", ["Germany", "France"], [], cols).count() == 1
    assert parse.search(df, "tools in Germany or France", ["Germany", "France"], [], cols).count() == 2


def test_boxes(spark):
    random.seed(2)
    rows = [(i % 2, i, *(lambda y, x: (y, x, y + 10.0, x + 10.0))(random.uniform(0, 60), random.uniform(0, 60)), random.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, box_id long, y0 double, x0 double, y1 double, x1 double, confidence double")
    apart = geometry.back_off(df)
    assert geometry.overlapping(apart.select("page_id", "box_id", *geometry.BOX), "page_id", "box_id", 10.0).where("iou > 1e-9").count() == 0
    crop = geometry.in_crop(spark.createDataFrame([(1, 0.3, 0.3, 0.5, 0.5), (2, 0.0, 0.0, 0.1, 0.1)], "b int, y0 double, x0 double, y1 double, x1 double"), (0.25, 0.25, 0.75, 0.75)).collect()
    assert [r.b for r in crop] == [1]
    assert (crop[0].y0, crop[0].y1) == (pytest.approx(0.5), pytest.approx(0.9))
    heat = np.zeros(21)
    assert geometry.boundaries(heat) == [0.0, 1.0]
    heat[9:12] = 1, 3, 1
    assert geometry.boundaries(heat) == [0.0, pytest.approx(0.5), 1.0]


def test_learning(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 0.1])], "id int, v array<double>")
    assert abs(learn.svd(df, "id", "v", 1).where("id = 1").first().svd[0]) == pytest.approx(3.0, abs=0.05)
    x = spark.createDataFrame([(1.0, 0.1), (2.0, -0.2), (0.5, 0.0)], "a double, b double")
    assert learn.ranknet(x, ["a", "b"])["a"] > 0
    assert learn._dtw(np.array([1.0, 2.0, 3.0]), np.array([1.0, 1.0, 2.0, 3.0]), 2) == 0
    assert math.isnan(learn._dtw(np.zeros(0), np.ones(2), 1))


def test_web(spark):
    assert one(spark, web.canonical, "HTTPS://Example.com/a/") == "http://www.example.com/a"
    assert one(spark, web.meta_description, '<meta name="description" content="a"><meta property="og:description" content="b">') == "b"
    assert one(spark, web.meta_description, "<p>") is None
    assert one(spark, lambda c: web.resolve(F.lit("http://a.org/x/y"), c), "/z") == "http://a.org/z"


def test_streams_match_batch(spark, tiny, tmp_path):
    batch = spark.read.parquet(f"{tiny}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    s = events.read(spark, str(tmp_path / "in"), batch.schema)
    q = events.write(events.windowed(s, late="400 days"), str(tmp_path / "out"), str(tmp_path / "cp"), mode="append")
    q.awaitTermination()
    assert q.exception() is None
    batch_windows = events.windowed(batch)
    assert batch_windows.agg(F.sum("n")).first()[0] == batch.count()
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_fetch_tries_again_and_gives_up():
    asked = []

    def get(url, n):
        asked.append((url, n))
        if url == "down":
            raise TimeoutError
        return (503, "") if n < 3 else (200, "text")

    assert fetch.fetch(get, "u", 5) == (200, "text", 3)
    assert fetch.fetch(get, "u", 2) == (503, None, 2)
    assert fetch.fetch(get, "down", 4) == (0, None, 4)
    assert fetch.fetch(lambda u, n: (404, "no"), "u") == (404, None, 1)


def test_index_of_two_appends(spark, tmp_path):
    for terms in (["a", "b"], ["b"]):
        df = spark.createDataFrame([(len(terms), terms)], "doc long, terms array<string>")
        io.save_index(df, f"{tmp_path}/i", "doc", "terms")
    assert {r.term: r.df for r in io.index_terms(spark, f"{tmp_path}/i").collect()} == {"a": 1, "b": 2}


def test_index_segments_after_many_appends(spark, tmp_path):
    docs = [(i, ["all", f"t{i % 3}", f"t{i % 3}", f"own{i}"]) for i in range(18)]
    df = spark.createDataFrame(docs, "doc long, terms array<string>")
    for part in range(6):
        io.save_index(df.where(F.col("doc") % 6 == part), f"{tmp_path}/i", "doc", "terms")
    io.save_index(df, f"{tmp_path}/whole", "doc", "terms")
    got, want = (sorted(map(tuple, io.index_terms(spark, f"{tmp_path}/{p}").collect())) for p in ("i", "whole"))
    assert got == want and ("all", 18) in got
    # four of the first level became one of the second
    assert len(io._segments(spark, f"{tmp_path}/i/terms")) == 3
    assert len(io._segments(spark, f"{tmp_path}/i/postings")) == 6
    io.save_index(df.where("doc = 0"), f"{tmp_path}/i", "doc", "terms", "overwrite")
    assert {r.term for r in io.index_terms(spark, f"{tmp_path}/i").collect()} == {"all", "t0", "own0"}


def test_queries_in_blocks_meet_all_rows(spark):
    q, r = spark.range(30).withColumnRenamed("id", "q"), spark.range(40).withColumnRenamed("id", "r")
    for each in (4, 100):
        got = relational.blocked_pairs(q, r, "q", "r", each).collect()
        assert sorted((x.q, x.r) for x in got) == [(a, b) for a in range(30) for b in range(40)]


def test_tokens_two_edits_apart_meet(spark):
    pairs = [("walker", "wlker"), ("walker", "wxlkxr"), ("walker", "walkers"), ("ab", "a"), ("abc", "a"), ("abcd", "abxycd"), ("abcd", "acbd")]
    df = spark.createDataFrame(pairs, "a string, b string")
    met = df.select(F.arrays_overlap(TS._shortened("a"), TS._shortened("b")).alias("m")).collect()
    assert all(r.m for r in met)
