"""Ranking metrics and annotator agreement over the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import relational as R
from ..operators.scan import scanned
from ..sources.io import table
from .registry import query

#: Labels as annotations: task = source, analyst = doc_id % 3, relevance 0..2.
_a = "SELECT d.source AS task, d.doc_id % 3 AS analyst, d.doc_id, d.n_chars, (l.quality + 1 - l.toxic)::INTEGER AS rel FROM labels l JOIN documents d USING (doc_id)"


def annotations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select(F.col("source").alias("task"), (F.col("doc_id") % 3).alias("analyst"), "doc_id", "n_chars", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("rel"))


def order():
    return [-F.col("n_chars"), F.col("doc_id")]


@query("precision_at_k", f"SELECT task, doc_id, pos, hits::BIGINT AS hits, round(hits / pos, 6) AS precision FROM (SELECT *, row_number() OVER w AS pos, sum((rel > 0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM ({_a}) WINDOW w AS (PARTITION BY task ORDER BY n_chars DESC, doc_id))")
def precision_at_k(spark, sf):
    """MET1 WIN4 WIN5"""
    return K.running_precision(annotations(spark, sf), ["task"], "rel", order()).select("task", "doc_id", "pos", "hits", F.round("precision", 6).alias("precision"))


@query("average_precision", f"WITH p AS (SELECT task, analyst, rel, sum((rel > 0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w AS p FROM ({_a}) WINDOW w AS (PARTITION BY task, analyst ORDER BY n_chars DESC, doc_id)) SELECT task, analyst, round(coalesce(avg(CASE WHEN rel > 0 THEN p END), 0), 6) AS ap FROM p GROUP BY 1, 2")
def average_precision(spark, sf):
    """MET2 MET4 WIN6"""
    return K.average_precision(annotations(spark, sf), ["task", "analyst"], "rel", order())


@query("ndcg", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n_chars DESC, doc_id) AS p, row_number() OVER (PARTITION BY task ORDER BY rel DESC, doc_id) AS i FROM ({_a})) SELECT task, round(sum((pow(2, rel) - 1) / log2(p + 1)) / nullif(sum((pow(2, rel) - 1) / log2(i + 1)), 0), 6) AS ndcg FROM r GROUP BY 1")
def ndcg(spark, sf):
    """MET3 WIN7"""
    return K.ndcg(annotations(spark, sf), ["task"], "rel", order(), "doc_id")


@query("worst_tail", f"WITH p AS (SELECT task, analyst, avg((rel > 0)::INT) AS p FROM ({_a}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, task, analyst) AS i, count(*) OVER () AS n FROM p) SELECT c::INTEGER AS cut, round(p, 6) AS p FROM r JOIN (SELECT unnest([5, 10, 25]) AS c) c ON i = least(n, ceil((100 - c) * n / 100.0) + 1)")
def worst_tail(spark, sf):
    """MET9: final precision at the cuts of the worst 5, 10 and 25 % of lists; lists
    are few."""
    from pyspark.sql import window as W

    p = annotations(spark, sf).groupBy("task", "analyst").agg(F.avg((F.col("rel") > 0).cast("int")).alias("p"))
    r = p.withColumn("i", F.row_number().over(W.Window.orderBy(F.desc("p"), "task", "analyst"))).withColumn("n", F.count("*").over(W.Window.partitionBy()))
    hits = F.filter(F.array(*map(F.lit, (5, 10, 25))), lambda c: F.col("i") == F.least(F.col("n"), F.ceil((100 - c) * F.col("n") / 100.0) + 1))
    return r.select(F.explode(hits).alias("cut"), F.round("p", 6).alias("p"))


@query("rank_buckets", f"WITH r AS (SELECT doc_id, rel, row_number() OVER (PARTITION BY task ORDER BY n_chars DESC, doc_id) AS p FROM ({_a})), k AS (SELECT CASE WHEN rel > 1 THEN p ELSE -1 END AS rank FROM r) SELECT count(*) FILTER (rank BETWEEN 1 AND 10) AS top_10, count(*) FILTER (rank BETWEEN 1 AND 20) AS top_20, count(*) FILTER (rank BETWEEN 1 AND 50) AS top_50, count(*) FILTER (rank BETWEEN 1 AND 100) AS top_100, count(*) FILTER (rank > 100) AS beyond, count(*) FILTER (rank = -1) AS absent, round(avg(CASE WHEN rank BETWEEN 1 AND 20 THEN 1.0 / rank END), 6) AS mrr_hits, round(avg(CASE WHEN rank >= 1 THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM k")
def rank_buckets(spark, sf):
    """MET5-7"""
    r = scanned(annotations(spark, sf), ["task"], order(), "p")
    return K.rank_buckets(r.select(F.when(F.col("rel") > 1, F.col("p")).otherwise(-1).alias("rank")), "rank")


@query("mean_recall", f"WITH r AS (SELECT task, rel, row_number() OVER (PARTITION BY task ORDER BY n_chars DESC, doc_id) AS p FROM ({_a})), q AS (SELECT task, count(*) FILTER (rel > 0 AND p <= 10) / nullif(count(*) FILTER (rel > 0), 0) AS r10, count(*) FILTER (rel > 0 AND p <= 20) / nullif(count(*) FILTER (rel > 0), 0) AS r20 FROM r GROUP BY 1) SELECT round(avg(r10), 6) AS recall_10, round(avg(r20), 6) AS recall_20 FROM q")
def mean_recall(spark, sf):
    """MET8"""
    r = scanned(annotations(spark, sf), ["task"], order(), "p")
    hit = lambda k: F.try_divide(F.sum(((F.col("rel") > 0) & (F.col("p") <= k)).cast("int")), F.sum((F.col("rel") > 0).cast("int"))).alias(f"r{k}")
    return r.groupBy("task").agg(hit(10), hit(20)).agg(F.round(F.avg("r10"), 6).alias("recall_10"), F.round(F.avg("r20"), 6).alias("recall_20"))


@query("pairwise_preferences", f"WITH a AS ({_a}) SELECT x.task, x.analyst, x.doc_id AS better, y.doc_id AS worse, x.rel AS rel_better, y.rel AS rel_worse FROM a x JOIN a y ON x.task = y.task AND x.analyst = y.analyst AND x.rel > y.rel")
def pairwise_preferences(spark, sf):
    """JN15: the preferences are the result; lists are an analyst's on one task."""
    return K.preferences(annotations(spark, sf), ["task", "analyst"], "doc_id", "rel")


@query("preference_counts", f"WITH a AS ({_a}) SELECT x.task, count(y.doc_id) AS n_pairs FROM a x LEFT JOIN a y ON x.task = y.task AND x.rel > y.rel GROUP BY 1")
def preference_counts(spark, sf):
    """ANN3 JN15"""
    return K.preference_counts(annotations(spark, sf), ["task"], "rel")


@query("kendall_tau", f"WITH a AS ({_a}), c AS (SELECT x.task, count(*) FILTER (x.rel > y.rel) AS concordant, count(*) FILTER (x.rel < y.rel) AS discordant FROM a x LEFT JOIN a y ON x.task = y.task AND (x.n_chars, -x.doc_id) > (y.n_chars, -y.doc_id) GROUP BY 1), n AS (SELECT task, count(*) AS n FROM a GROUP BY 1) SELECT task, concordant, discordant, round((concordant - discordant) / nullif(sqrt((concordant + discordant) * (n * (n - 1) / 2)), 0), 6) AS tau FROM c JOIN n USING (task)")
def kendall_tau(spark, sf):
    """RNK11 JN16 JN17: longer documents are ranked first."""
    return K.inversion_counts(annotations(spark, sf), ["task"], "rel", order())


@query("annotator_agreement", f"WITH a AS (SELECT task, doc_id // 3 AS item, analyst, (rel > 1)::INT AS y FROM ({_a})), p AS (SELECT x.task, x.item, count(*) FILTER (x.y = y.y) AS same, count(*) AS n FROM a x JOIN a y ON x.task = y.task AND x.item = y.item AND x.analyst < y.analyst GROUP BY 1, 2), q AS (SELECT task, sum(same)::BIGINT AS agreeing, sum(n)::BIGINT AS pairs FROM p GROUP BY 1), c AS (SELECT task, item, max(c) AS top, sum(c) AS n FROM (SELECT task, item, y, count(*) AS c FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2), m AS (SELECT task, count(*) FILTER (top * 2 > n) AS majority, count(*) FILTER (top * 2 = n) AS stalemate FROM c GROUP BY 1) SELECT m.task, coalesce(agreeing, 0) AS agreeing, coalesce(pairs, 0) AS pairs, majority, stalemate FROM m LEFT JOIN q USING (task)")
def annotator_agreement(spark, sf):
    """ANN2 ANN3 ANN6 JN20"""
    a = annotations(spark, sf).select("task", F.floor(F.col("doc_id") / 3).alias("item"), "analyst", (F.col("rel") > 1).cast("int").alias("y"))
    return K.agreement(a, "task", "item", "analyst", "y")


@query(
    "krippendorff",
    f"""
    WITH a AS (SELECT doc_id // 3 AS item, rel AS v FROM ({_a})), c AS (SELECT item, v, count(*)::DOUBLE AS c FROM a GROUP BY 1, 2), m AS (SELECT item, sum(c) AS m FROM c GROUP BY 1 HAVING sum(c) > 1),
    o AS (SELECT x.v AS a, y.v AS b, sum(CASE WHEN x.v = y.v THEN x.c * (x.c - 1) ELSE x.c * y.c END / (m.m - 1)) AS o FROM c x JOIN c y USING (item) JOIN m USING (item) GROUP BY 1, 2), g AS (SELECT a AS v, sum(o) AS n FROM o GROUP BY 1), h AS (SELECT *, sum(n) OVER (ORDER BY v) AS cum FROM g),
    d AS (SELECT x.v AS a, y.v AS b, x.n AS na, y.n AS nb, pow(y.cum - x.cum + x.n / 2 - y.n / 2, 2) AS delta FROM h x JOIN h y ON x.v < y.v)
    SELECT round(1 - ((SELECT sum(n) FROM g) - 1) * sum(coalesce(o.o, 0) * delta) / nullif(sum(na * nb * delta), 0), 6) AS alpha FROM d LEFT JOIN o USING (a, b)
    """,
)
def krippendorff(spark, sf):
    """ANN5"""
    a = annotations(spark, sf).select(F.floor(F.col("doc_id") / 3).alias("item"), F.col("rel").alias("v"))
    return K.krippendorff(a, "item", "v")


@query("filled_annotations", f"WITH a AS ({_a}), i AS (SELECT DISTINCT task, doc_id // 3 AS item FROM a), n AS (SELECT DISTINCT task, analyst FROM a), b AS (SELECT task, doc_id // 3 AS item, analyst, max(rel) AS rel FROM a GROUP BY 1, 2, 3) SELECT i.task, i.item, n.analyst, coalesce(b.rel, 0) AS rel FROM i JOIN n USING (task) LEFT JOIN b ON b.task = i.task AND b.item = i.item AND b.analyst = n.analyst")
def filled_annotations(spark, sf):
    """SET7 ANN8: every item of a task for each of its analysts, missing ones 0."""
    a = annotations(spark, sf).withColumn("item", F.floor(F.col("doc_id") / 3))
    best = a.groupBy("task", "item", "analyst").agg(F.max("rel").alias("rel"))
    return R.complete(best, best.select("task", "item").distinct(), best.select("task", "analyst").distinct(), ["task", "item", "analyst"], {"rel": 0})


@query("mixed_groups", f"WITH a AS ({_a}) SELECT task, analyst, doc_id, rel FROM (SELECT *, min(rel) OVER (PARTITION BY task, analyst) AS lo, max(rel) OVER (PARTITION BY task, analyst) AS hi FROM a) WHERE lo <> hi")
def mixed_groups(spark, sf):
    """FLT20 JN18: lists whose labels are all equal are dropped."""
    a = annotations(spark, sf)
    mixed = a.groupBy("task", "analyst").agg(F.min("rel").alias("lo"), F.max("rel").alias("hi")).where("lo <> hi")
    return a.join(mixed.select("task", "analyst"), ["task", "analyst"], "left_semi").select("task", "analyst", "doc_id", "rel")


@query("gold_accuracy", f"WITH a AS ({_a}) SELECT analyst, count(*) AS n, round(avg((a.rel = g.gold)::INT), 6) AS accuracy FROM a JOIN (SELECT task, rel AS gold FROM (SELECT task, rel, row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, rel) AS k FROM a GROUP BY 1, 2) WHERE k = 1) g USING (task) GROUP BY 1")
def gold_accuracy(spark, sf):
    """ANN7 JN28: analysts against the commonest label of their task."""
    a = annotations(spark, sf)
    g = R.first_by(a.groupBy("task", "rel").agg(F.count("*").alias("n")), ["task"], [F.desc("n"), F.asc("rel")]).select("task", F.col("rel").alias("gold"))
    return a.join(g, "task").groupBy("analyst").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rel") == F.col("gold")).cast("int")), 6).alias("accuracy"))


@query("entity_resolution", "SELECT o.o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS entity FROM orders o LEFT JOIN customer a ON a.c_custkey = o.o_custkey AND o.o_orderkey % 2 = 0 LEFT JOIN customer b ON b.c_name = printf('Customer#%09d', o.o_custkey)")
def entity_resolution(spark, sf):
    """JN19 JN27: by id where there is one, else by name."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("id"), F.format_string("Customer#%09d", F.col("o_custkey")).alias("name"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    by_id, by_name = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("a")), c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("b"))
    return o.join(by_id, "id", "left").join(by_name, "name", "left").select("o_orderkey", F.coalesce("a", "b").alias("entity"))
