"""Vector search, centres, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import vectorsearch as V
from ..sources.io import kept, table
from .registry import query

_pairs = "SELECT q.vec_id AS query, v.vec_id, q.label AS ql, v.label AS vl, q.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0"
_kinds = {
    "l2": "-list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "inner": "list_dot_product(a, b)",
    "cosine": "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))",
}
_tier = "CASE WHEN ql = vl THEN 0 WHEN ql % 2 = vl % 2 THEN 1 ELSE 2 END"


def _sql(kind: str, tier: str = "0", k: int = 10) -> str:
    return f"WITH s AS (SELECT query, vec_id, ({tier})::BIGINT AS tier, round({_kinds[kind]}, 6) AS score FROM ({_pairs})) SELECT query, vec_id, tier, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"


def queries_of(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0")


def _knn(kind):
    return lambda spark, sf: V.knn(queries_of(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", 10, kind)


#: VEC1-5 JN26 SRT8: ids that 20 divides against all vectors.
for _k in _kinds:
    query(f"knn_{_k}", _sql(_k))(_knn(_k))


@query("tiered_topk", _sql("l2", _tier, 60))
def tiered_topk(spark, sf):
    """SRT10: same label, then same parity, then any."""
    return V.knn(queries_of(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", 60, "l2", (F.col("label"), F.col("label") % 2))


@query("merged_candidates", f"WITH i AS ({_sql('inner')}), l AS ({_sql('l2')}), u AS (SELECT query, vec_id FROM i UNION SELECT query, vec_id FROM l), s AS (SELECT query, vec_id, round({_kinds['cosine']}, 6) AS score FROM ({_pairs}) JOIN u USING (query, vec_id)) SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s")
def merged_candidates(spark, sf):
    """SRT13 SRT15: two candidate sets united, ranked by one score."""
    e = table(spark, sf, "embeddings")
    a, b = (V.knn(queries_of(spark, sf), e, "vec_id", "embedding", 10, k).select("query", "vec_id") for k in ("inner", "l2"))
    u = a.union(b).distinct()
    q = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    s = u.join(q, "query").join(e, "vec_id").select("query", "vec_id", F.round(N.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return V.top_k(s, ["query"], [F.desc("score"), F.asc("vec_id")], 1 << 30)


_centres = "c AS (SELECT label, list(x ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1), d AS (SELECT e.vec_id, e.label AS own, c.label, round(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM embeddings e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS rank FROM d)"


def two_nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.nearest_centres(e, "vec_id", "embedding", V.centres(e, "label", "embedding"), "label")


@query("nearest_centroid", f"WITH {_centres} SELECT vec_id, label, round(d, 4) AS d, rank FROM r WHERE rank = 1")
def nearest_centroid(spark, sf):
    """VEC15 AGG33"""
    return two_nearest(spark, sf).where("rank = 1").withColumn("d", F.round("d", 4))


@query("second_nearest_gap", f"WITH {_centres} SELECT vec_id, round((max(d) FILTER (rank = 2) - max(d) FILTER (rank = 1)) / greatest(max(d) FILTER (rank = 1), max(d) FILTER (rank = 2)), 5) AS gap FROM r GROUP BY 1")
def second_nearest_gap(spark, sf):
    """VEC16"""
    return V.gap_loss(two_nearest(spark, sf), "vec_id")


@query("cluster_scores", f"WITH {_centres} SELECT r.label, count(*) AS n, round(avg((e.embedding[1] + e.embedding[2]) / 2.0), 5) AS score FROM r JOIN embeddings e USING (vec_id) WHERE rank = 1 GROUP BY 1")
def cluster_scores(spark, sf):
    """VEC17"""
    e = table(spark, sf, "embeddings").select("vec_id", ((F.col("embedding")[0] + F.col("embedding")[1]) / 2.0).alias("s"))
    return two_nearest(spark, sf).where("rank = 1").join(e, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 5).alias("score"))


@query("knn_purity", f"WITH k AS ({_sql('l2')}) SELECT k.query, count(DISTINCT e.label) AS labels, (count(DISTINCT e.label) = 1)::INTEGER AS pure FROM k JOIN embeddings e USING (vec_id) GROUP BY 1")
def knn_purity(spark, sf):
    """VEC18"""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    k = V.knn(queries_of(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", 10).join(e, "vec_id")
    n = F.count_distinct("label")
    return k.groupBy("query").agg(n.alias("labels"), (n == 1).cast("int").alias("pure"))


@query("vector_long_form", "SELECT vec_id, (i - 1)::INTEGER AS i, round(x, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x > 0")
def vector_long_form(spark, sf):
    """VEC11 ARR1"""
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where("x > 0").select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("coordinate_shift", "WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, least(0, min(x)) AS m FROM l GROUP BY 1) SELECT vec_id, l.i::INTEGER AS i, round(x - m, 6) AS x FROM l JOIN m USING (i)")
def coordinate_shift(spark, sf):
    """AGG24: each coordinate less its minimum, if negative."""
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m = long.groupBy("i").agg(F.least(F.lit(0.0), F.min("x")).alias("m"))
    return long.join(F.broadcast(m), "i").select("vec_id", "i", F.round(F.col("x") - F.col("m"), 6).alias("x"))


@query("one_hot", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS b, (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS m FROM customer")
def one_hot(spark, sf):
    """VEC8 VEC10"""
    from ..operators.learn import one_hot as hot

    v = hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return table(spark, sf, "customer").select("c_custkey", v[0].alias("b"), v[1].alias("m"))


@query("standardised", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z_price FROM part")
def standardised(spark, sf):
    """VEC9"""
    from ..operators.learn import standardise

    out = standardise(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.col("features")[0].alias("z_size"), F.col("features")[1].alias("z_price"))


@query("mean_hop", "WITH n AS (SELECT n_nationkey, dense_rank() OVER (ORDER BY n_name) - 1 AS node FROM nation), m AS (SELECT c_nationkey, avg(c_acctbal) AS h FROM customer GROUP BY 1) SELECT c.c_custkey, n.node, round(m.h, 4) AS h FROM customer c JOIN n ON c.c_nationkey = n.n_nationkey JOIN m ON m.c_nationkey = c.c_nationkey")
def mean_hop(spark, sf):
    """GRF1: edges customer -> nation with node ids, and one mean hop over them."""
    from pyspark.sql import window as W

    n = table(spark, sf, "nation").select("n_nationkey", (F.dense_rank().over(W.Window.orderBy("n_name")) - 1).cast("long").alias("node"))
    c = table(spark, sf, "customer")
    m = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("h"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(m, "c_nationkey").select("c_custkey", "node", F.round("h", 4).alias("h"))


@query("link_auc", f"WITH s AS (SELECT round({_kinds['inner']}, 6) AS score, (ql = vl)::INT AS y FROM ({_pairs})), r AS (SELECT y, count(*) AS c, sum(count(*)) OVER (ORDER BY score) - count(*) + (count(*) + 1) / 2.0 AS rank, score FROM s GROUP BY score, y), t AS (SELECT score, sum(c) AS c, sum(c) FILTER (y = 1) AS p FROM r GROUP BY 1), u AS (SELECT *, sum(c) OVER (ORDER BY score) - c + (c + 1) / 2.0 AS rk FROM t) SELECT round((sum(coalesce(p, 0) * rk) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(c) - sum(p))), 6)::DOUBLE AS auc FROM u")
def link_auc(spark, sf):
    """GRF3: AUC of the inner product for pairs with equal labels, by rank sums; equal scores
    are counted first, and ranked in bins of a tenth."""
    from pyspark.sql import window as W

    t = kept(V.inner_tally(queries_of(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", "label"), "scores")
    t = t.withColumn("bin", F.floor(F.col("score") * 10))
    starts = t.groupBy("bin").agg(F.sum("c").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.Window.orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("c").over(W.Window.partitionBy("bin").orderBy("score").rowsBetween(W.Window.unboundedPreceding, 0))
    u = t.join(F.broadcast(starts), "bin").withColumn("rk", F.col("start") + own - F.col("c") + (F.col("c") + 1) / 2)
    p = F.sum("p").cast("double")
    return u.agg(F.round((F.sum(F.col("p") * F.col("rk")) - p * (p + 1) / 2) / (p * (F.sum("c") - p)), 6).alias("auc"))
