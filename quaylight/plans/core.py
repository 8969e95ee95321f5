"""Scans, projections, filters, joins, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import numbers as N
from ..functions import text as X
from ..operators import relational as R
from ..operators import sampling as S
from ..operators.scan import at_ranks, quantiles
from ..sources.io import lower_columns, of_types, prefix_columns, table
from .registry import query


@query("scan_project_filter", "SELECT doc_id, lang, source, n_chars, text AS description FROM documents WHERE text IS NOT NULL AND length(text) > 10")
def scan_project_filter(spark, sf):
    """SRC1 PRJ1 FLT1"""
    d = lower_columns(table(spark, sf, "documents")).where(F.col("text").isNotNull() & (F.length("text") > 10))
    return d.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("description"))


@query("year_range_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def year_range_scan(spark, sf):
    """FLT5 FLT6 DAT1"""
    return R.prune_to_years(table(spark, sf, "orders"), "o_orderdate", 1996, 1998).select("o_orderkey", "o_custkey", "o_totalprice")


@query("in_lists_and_bands", "SELECT c.c_custkey, c.c_mktsegment, n.n_name, round(c.c_acctbal, 2) AS c_acctbal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name IN ('EUROPE', 'ASIA') AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND c.c_acctbal > 1000 AND c.c_acctbal <= 9000")
def in_lists_and_bands(spark, sf):
    """FLT3 FLT4 FLT7 JN21: lists of regions expanded by a dimension, half-open band."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region").where(F.col("r_name").isin("EUROPE", "ASIA")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 1000) & (F.col("c_acctbal") <= 9000))
    return c.join(places, c.c_nationkey == places.n_nationkey).select("c_custkey", "c_mktsegment", "n_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(
    "role_prefix_self_join",
    """
    WITH s AS (SELECT c_custkey, lead(c_custkey, 1) OVER w AS a, lead(c_custkey, 2) OVER w AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)),
    e AS (SELECT c_custkey, a AS k FROM s WHERE a IS NOT NULL UNION ALL SELECT c_custkey, b FROM s WHERE b IS NOT NULL)
    SELECT e.c_custkey, p.c_custkey AS competitor_c_custkey, p.c_name AS competitor_c_name, round(p.c_acctbal, 2) AS competitor_c_acctbal FROM e JOIN customer p ON p.c_custkey = e.k WHERE p.c_acctbal > 0
    """,
)
def role_prefix_self_join(spark, sf):
    """PRJ2 JN10 ARR1: competitor ids as an array, exploded, joined for their attributes."""
    c = table(spark, sf, "customer")
    w = W.Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    ids = c.select("c_custkey", F.array_compact(F.array(F.lead("c_custkey", 1).over(w), F.lead("c_custkey", 2).over(w))).alias("ids"))
    p = prefix_columns(c.select("c_custkey", "c_name", "c_acctbal"), "competitor_").where("competitor_c_acctbal > 0")
    return ids.select("c_custkey", F.explode("ids").alias("competitor_c_custkey")).join(p, "competitor_c_custkey").withColumn("competitor_c_acctbal", F.round("competitor_c_acctbal", 2))


@query("gapless_row_id", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 + 1 AS row_id FROM supplier")
def gapless_row_id(spark, sf):
    """PRJ7 PRJ9 WIN2 AGG23"""
    return R.gapless_ids(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", offset=1)


@query("default_fill", "SELECT p_partkey, substring(p_name, 1, 10) AS p_short, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS p_brand, coalesce(nullif(p_size, 1), 0)::INTEGER AS p_size FROM part")
def default_fill(spark, sf):
    """PRJ11 PRJ12 PRJ6: defaults for missing values, texts cut."""
    p = table(spark, sf, "part").select("p_partkey", F.substring("p_name", 1, 10).alias("p_short"), F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"), F.nullif("p_size", F.lit(1)).alias("p_size"))
    return p.na.fill({"p_brand": "none", "p_size": 0})


@query("columns_by_type", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE length(o_orderstatus) > 0 OR length(o_orderpriority) > 0")
def columns_by_type(spark, sf):
    """PRJ13 FLT2: the double columns, rows with any text."""
    o = table(spark, sf, "orders")
    any_text = F.lit(False)
    for c in of_types(o, "string"):
        any_text = any_text | (F.length(c) > 0)
    return o.where(any_text).select("o_orderkey", *(F.round(c, 2).alias(c) for c in of_types(o, "double")))


@query("dup_key_antijoin", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 2) AS l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dup_key_antijoin(spark, sf):
    """FLT10 AGG2"""
    return R.without_repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 2).alias("l_quantity"))


@query(
    "order_of_magnitude_band",
    """
    WITH t AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS top FROM customer GROUP BY 1, 2)
    SELECT c.c_custkey, round(t.top, 2) AS target FROM customer c JOIN t USING (c_nationkey, c_mktsegment) WHERE c.c_acctbal BETWEEN 0.1 * t.top AND 10 * t.top
    """,
)
def order_of_magnitude_band(spark, sf):
    """FLT8 FLT9: customers within a tenth to ten times of their group's leader."""
    c = table(spark, sf, "customer")
    t = c.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("top"))
    return c.join(t, ["c_nationkey", "c_mktsegment"]).where(F.col("c_acctbal").between(0.1 * F.col("top"), 10 * F.col("top"))).select("c_custkey", F.round("top", 2).alias("target"))


@query("semi_restrict", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_restrict(spark, sf):
    """JN5 SET5"""
    c = table(spark, sf, "customer").where("c_acctbal > 5000")
    o = table(spark, sf, "orders")
    return R.semi(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey")


@query("anti_restrict", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_restrict(spark, sf):
    """SET5"""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return R.anti(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query(
    "array_membership",
    """
    WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS used FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, (o.o_orderkey % 100 + 1) AS offered, len(s.used)::BIGINT AS n_used FROM orders o JOIN s ON o.o_orderkey = s.l_orderkey WHERE NOT list_contains(s.used, o.o_orderkey % 100 + 1) AND len(s.used) > 0
    """,
)
def array_membership(spark, sf):
    """FLT11 FLT13 ARR5: not a member of an array."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("used"))
    o = table(spark, sf, "orders").withColumn("offered", F.col("o_orderkey") % 100 + 1)
    out = o.join(s, o.o_orderkey == s.l_orderkey).where(~F.array_contains("used", F.col("offered")) & (F.size("used") > 0))
    return out.select("o_orderkey", "offered", F.size("used").cast("long").alias("n_used"))


@query("point_lookup", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf):
    """FLT14 FLT12"""
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("agg_counts_distinct", "SELECT c_nationkey, c_mktsegment, count(*) AS n, count(DISTINCT c_name) AS n_names, max(length(c_name))::BIGINT AS longest, min(length(c_name))::BIGINT AS shortest, round(avg(length(c_name)), 6) AS mean_length FROM customer GROUP BY 1, 2")
def agg_counts_distinct(spark, sf):
    """AGG1 AGG5 AGG6 AGG12"""
    n = F.length("c_name")
    return table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_name").alias("n_names"), F.max(n).cast("long").alias("longest"), F.min(n).cast("long").alias("shortest"), F.round(F.avg(n), 6).alias("mean_length"))


@query(
    "mode_and_share",
    """
    WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM c)
    SELECT c_nationkey, c_mktsegment, n, round(share, 6) AS share FROM r WHERE k = 1
    """,
)
def mode_and_share(spark, sf):
    """AGG22 WIN16: the commonest segment of each nation and its share."""
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.Window.partitionBy("c_nationkey")), 6))
    return R.first_by(c, ["c_nationkey"], [F.desc("n"), F.asc("c_mktsegment")])


@query(
    "merge_duplicates",
    """
    SELECT md5(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))) AS k, min(doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ', ') AS source, round(avg(n_chars::DOUBLE), 4) AS mean_chars, trunc(avg(n_chars))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest, arg_min(doc_id, (-length(text), doc_id)) AS widest
    FROM documents GROUP BY 1
    """,
)
def merge_duplicates(spark, sf):
    """AGG9 AGG12 AGG13 STR1: one row for each normal text, columns merged by type."""
    d = table(spark, sf, "documents").withColumn("k", F.md5(X.clean_text(F.col("text")).cast("binary")))
    return d.groupBy("k").agg(
        F.min("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source"), F.round(F.avg(F.col("n_chars").cast("double")), 4).alias("mean_chars"), F.avg("n_chars").cast("long").alias("n_chars"),
        F.max(F.length("text")).cast("long").alias("longest"), F.min_by("doc_id", F.struct(-F.length("text"), F.col("doc_id"))).alias("widest"),
    )


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_rows(spark, sf):
    """AGG3"""
    return table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("top_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def top_groups(spark, sf):
    """AGG14 SRT1: the ten suppliers with most lines."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


_splits = [-1000.0, 0.0, 1000.0, 2000.0, 4000.0, 6000.0, 8000.0, 10000.0]
_case = " ".join(f"WHEN c_acctbal >= {a} AND c_acctbal < {b} THEN {i}" for i, (a, b) in enumerate(zip(_splits, _splits[1:], strict=False)))


@query("histogram_global", f"WITH b AS (SELECT CASE {_case} END AS bucket FROM customer), g AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1) SELECT bucket, n, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS pct FROM g")
def histogram_global(spark, sf):
    """AGG20 VEC12: shares of all from the table's bucket counts."""
    g = table(spark, sf, "customer").select(N.bucket(F.col("c_acctbal"), _splits).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.Window.partitionBy()), 6))


@query(
    "histogram_by_group",
    f"WITH b AS (SELECT c_mktsegment, CASE {_case} END AS bucket, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT DISTINCT c_mktsegment FROM customer), k AS (SELECT unnest(range(7))::INTEGER AS bucket) SELECT s.c_mktsegment, k.bucket, coalesce(b.n, 0) AS n FROM s CROSS JOIN k LEFT JOIN b ON b.c_mktsegment = s.c_mktsegment AND b.bucket = k.bucket",
)
def histogram_by_group(spark, sf):
    """AGG21 SET7: every segment with every bucket, zero-filled."""
    b = table(spark, sf, "customer").select("c_mktsegment", N.bucket(F.col("c_acctbal"), _splits).alias("bucket")).groupBy("c_mktsegment", "bucket").agg(F.count("*").alias("n"))
    spine = b.select("c_mktsegment").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return spine.join(b, ["c_mktsegment", "bucket"], "left").na.fill({"n": 0})


@query("percentile_curve", "SELECT o_orderpriority, p::INTEGER AS p, round(v, 4) AS v FROM (SELECT o_orderpriority, unnest([5, 25, 50, 75, 95]) AS p, unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM orders GROUP BY 1)")
def percentile_curve(spark, sf):
    """AGG30: percentiles by linear interpolation."""
    q = quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("o_orderpriority", F.round(F.col("q") * 100).cast("int").alias("p"), F.round("o_totalprice", 4).alias("v"))


@query(
    "quantile_cuts",
    """
    WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice > 0)
    SELECT o_orderpriority, s.k::INTEGER AS k, round(o_totalprice + 1.0, 4) AS cut FROM r CROSS JOIN (SELECT unnest(range(8)) AS k) s WHERE i = least(ceil((s.k + 1) * n / 8.0), n - 1)
    """,
)
def quantile_cuts(spark, sf):
    """AGG29: the value at index least(ceil((k+1) n / 8), n-1) of the sorted positives,
    plus 1, for each k."""
    index = lambda k, n: F.least(F.ceil((k + 1) * n / 8.0), n - 1)
    eight = F.sequence(F.lit(0), F.lit(7))
    r = at_ranks(table(spark, sf, "orders").where("o_totalprice > 0"), ["o_orderpriority"], "o_totalprice", lambda n: F.transform(eight, lambda k: index(k, n)))
    ks = F.filter(eight, lambda k: F.col("rank") == index(k, F.col("n")))
    return r.select("o_orderpriority", F.explode(ks).alias("k"), F.round(F.col("o_totalprice") + 1.0, 4).alias("cut"))


@query("quantise_values", "SELECT o_orderkey, (2 + (v >= -50000)::INT + (v >= -10000)::INT + (v >= 0)::INT + (v >= 10000)::INT + (v >= 50000)::INT)::INTEGER AS bucket FROM (SELECT o_orderkey, o_totalprice - 60000 AS v FROM orders)")
def quantise_values(spark, sf):
    """VEC13 VEC14"""
    return table(spark, sf, "orders").select("o_orderkey", N.quantise(F.col("o_totalprice") - 60000, [10000.0, 50000.0]).alias("bucket"))


@query("min_max_scaled", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)) * 2 - 1, 6) AS scaled FROM customer")
def min_max_scaled(spark, sf):
    """AGG37"""
    from ..operators.series import min_max_table

    return min_max_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", -1.0, 1.0).select("c_custkey", "scaled")


@query("union_dedupe", "SELECT k, arg_min(name, (src, name)) AS name FROM (SELECT c_nationkey AS k, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier) GROUP BY 1")
def union_dedupe(spark, sf):
    """SET1 SET2 AGG4: two vendors united, the first's row wins."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(0).alias("src"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("src"))
    return R.first_by(a.union(b), ["k"], [F.col("src"), F.col("name")]).select("k", "name")


@query(
    "strat_hash_sample",
    "WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c.c_custkey, c.c_mktsegment FROM customer c JOIN n USING (c_mktsegment) WHERE (c.c_custkey * 2654435761) % 4294967296 < least(1.0, 40.0 / n.n) * 4294967296.0",
)
def strat_hash_sample(spark, sf):
    """SMP1"""
    return S.stratified(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", 40).select("c_custkey", "c_mktsegment")


@query(
    "quota_sample",
    """
    WITH q AS (SELECT *, 20 AS quota, (c_custkey * 2654435761) % 4294967296 AS h, count(*) OVER (PARTITION BY c_mktsegment) AS have FROM customer),
    s AS (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS strata FROM customer GROUP BY 1),
    f AS (SELECT q.*, (row_number() OVER (PARTITION BY q.c_mktsegment, c_nationkey ORDER BY h, c_custkey) <= ceil(quota * 1.0 / strata)) AS fst FROM q JOIN s ON q.c_mktsegment = s.c_mktsegment WHERE have >= quota)
    SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY fst DESC, h, c_custkey) AS k FROM f) WHERE k <= quota
    """,
)
def quota_sample(spark, sf):
    """SMP2"""
    c = table(spark, sf, "customer")
    quotas = c.select("c_mktsegment").distinct().withColumn("quota", F.lit(20))
    return S.quota(c, "c_mktsegment", ["c_nationkey"], "c_custkey", quotas).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("group_split", "SELECT doc_id, source, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'test' WHEN h < 100 THEN 'val' END AS split FROM (SELECT doc_id, source, (((substring(source, 4)::BIGINT + 345) * 2654435761) % 4294967296) % 100 AS h FROM documents)")
def group_split(spark, sf):
    """SMP6 SMP7 SNK7: a whole source in one split."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", S.split_name(F.substring("source", 4, 20).cast("long"), {"train": 70, "test": 15, "val": 15}, seed=345).alias("split"))


@query(
    "neg_sample",
    "WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), d AS (SELECT c_custkey, unnest(range(1, 4))::INTEGER AS draw FROM customer) SELECT d.c_custkey, d.draw, p.s_suppkey FROM d JOIN p ON p.i = (((d.c_custkey * 131 + d.draw) * 2654435761) % 4294967296) % p.n",
)
def neg_sample(spark, sf):
    """SMP4 JN8 ARR2"""
    s = R.gapless_ids(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", name="i")
    return S.negatives(table(spark, sf, "customer"), "c_custkey", s, "i", s.count(), 3).select("c_custkey", "draw", "s_suppkey")


@query("first_observations", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 5 AND n >= 5")
def first_observations(spark, sf):
    """WIN11 FLT18: the first five of users with five or more."""
    e = table(spark, sf, "events")
    enough = e.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5")
    return R.top_k(R.semi(e, enough, "user_id"), ["user_id"], [F.col("ts"), F.col("event_id")], 5, "k").select("user_id", "event_id", "k")


@query("json_extract_ops", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, trunc((props::JSON->>'k')::DOUBLE / 7)::BIGINT AS k7, (props::JSON->>'missing') IS NULL AS gone FROM events")
def json_extract_ops(spark, sf):
    """JSN1-4 PRJ3: JSON by schema and by path."""
    p = F.from_json("props", "k long, missing string")
    return table(spark, sf, "events").withColumn("p", p).select("event_id", F.col("p.k").alias("k"), (F.get_json_object("props", "$.k").try_cast("double") / 7).cast("long").alias("k7"), F.col("p.missing").isNull().alias("gone"))


@query("distribution_threshold", "WITH s AS (SELECT unnest(range(100)) AS n), g AS (SELECT s.n, avg((abs(e.value) < s.n)::INT) AS share FROM s CROSS JOIN events e GROUP BY 1) SELECT max(n)::INTEGER AS last_n, min(n)::INTEGER AS first_n FROM g WHERE share > 0.5")
def distribution_threshold(spark, sf):
    """AGG38: the last (and the first) n below 100 with over half of the values nearer
    to 0. Values are counted by their whole part first, at most 101 rows."""
    e = table(spark, sf, "events").where(F.col("value").isNotNull())
    c = e.groupBy(F.least(F.floor(F.abs("value")), F.lit(100)).alias("f")).agg(F.count("*").alias("c"))
    t = c.agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("f", "c"))).alias("m"))
    below = lambda n: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0)))
    ok = F.filter(F.sequence(F.lit(0), F.lit(99)), lambda n: F.when(n > 0, below(n) / F.col("all") > 0.5).otherwise(False))
    return t.select(F.array_max(ok).alias("last_n"), F.array_min(ok).alias("first_n"))


@query("min_observations", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 30")
def min_observations(spark, sf):
    """AGG36 FLT18: sectors with over 30 members."""
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).where("n > 30")


@query(
    "label_mapping",
    "SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 3 END::INTEGER AS relevance, (CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 3 END > 0)::INTEGER AS positive FROM labels",
)
def label_mapping(spark, sf):
    """ANN1 ANN2: labels to 0..3 and to 0/1."""
    rel = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(3)
    return table(spark, sf, "labels").select("doc_id", rel.alias("relevance"), (rel > 0).cast("int").alias("positive"))


@query("script_sort", "SELECT c_custkey, round(abs(c_acctbal - 5000), 2) AS gap, row_number() OVER (ORDER BY abs(c_acctbal - 5000), c_custkey) AS pos FROM customer ORDER BY 3 LIMIT 50")
def script_sort(spark, sf):
    """SRT11 SRT1 WIN3: the fifty nearest to an origin, missing values last."""
    c = table(spark, sf, "customer").withColumn("g", F.coalesce(F.abs(F.col("c_acctbal") - 5000), F.lit(float("inf"))))
    top = c.orderBy("g", "c_custkey").limit(50)
    return top.select("c_custkey", F.round("g", 2).alias("gap"), F.row_number().over(W.Window.orderBy("g", "c_custkey")).cast("long").alias("pos"))
