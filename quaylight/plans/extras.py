"""Smaller operators: columns, filters, joins, aggregates, samples, texts and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import numbers as N
from ..functions import stem
from ..functions import text as X
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import series
from ..operators import textsearch as TS
from ..operators import web
from ..operators.scan import scanned
from ..sources.io import table
from . import texts
from .registry import query
from .rankings import _a, annotations


@query("ratio_columns", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio, l_linestatus AS l_returnflag, l_returnflag AS l_linestatus FROM lineitem")
def ratio_columns(spark, sf):
    """PRJ4 PRJ5 PRJ14: a ratio that is null over zero, two columns swapped, in a given order."""
    out = table(spark, sf, "lineitem").withColumn("ratio", F.round(N.ratio(F.col("l_tax"), F.col("l_discount")), 6))
    return out.withColumnsRenamed({"l_returnflag": "_f", "l_linestatus": "l_returnflag"}).withColumnRenamed("_f", "l_linestatus").select("l_orderkey", "l_linenumber", "ratio", "l_returnflag", "l_linestatus")


@query("opaque_ids", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def opaque_ids(spark, sf):
    """PRJ8: ids that differ and mean nothing."""
    return table(spark, sf, "orders").select(F.monotonically_increasing_id().alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("sampler_years", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <= 1999 - 1 AND o_totalprice > 0.1 * 150000 AND o_totalprice < 10 * 15000")
def sampler_years(spark, sf):
    """FLT6 FLT9: years before the end year, a band with open ends."""
    o = R.prune_to_years(table(spark, sf, "orders"), "o_orderdate", 1996, 1998).where((F.col("o_totalprice") > 15000) & (F.col("o_totalprice") < 150000))
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("model_band", "WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sigma FROM customer GROUP BY 1) SELECT c_custkey FROM customer JOIN m USING (c_nationkey) WHERE c_acctbal BETWEEN mean - 0.1 * sigma AND mean + 1.96 * sigma")
def model_band(spark, sf):
    """FLT8b: within -0.1 to 1.96 deviations of a group's mean."""
    c = table(spark, sf, "customer")
    m = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sigma"))
    return c.join(m, "c_nationkey").where(F.col("c_acctbal").between(F.col("mean") - 0.1 * F.col("sigma"), F.col("mean") + 1.96 * F.col("sigma"))).select("c_custkey")


@query("column_equality", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = l_linenumber")
def column_equality(spark, sf):
    """FLT12"""
    return table(spark, sf, "lineitem").where(F.col("l_quantity") == F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("duplicate_reasons", "SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'A Duplicate of ' || user_id ELSE event_type END AS reason FROM events WHERE event_type <> 'click'")
def duplicate_reasons(spark, sf):
    """FLT21: rows whose reason says duplicate go, rows without a reason stay."""
    reason = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", F.concat(F.lit("A Duplicate of "), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", reason.alias("reason"))
    return e.where(~F.coalesce(F.lower("reason").contains("duplicate"), F.lit(False)))


@query("boolean_search", "SELECT doc_id, score FROM (SELECT doc_id, (2.0 * (source = (SELECT min(source) FROM documents))::INT + (text LIKE '%on%')::INT + 0.5 * (n_chars > 2000)::INT)::DOUBLE AS score FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 100 AND text IS NOT NULL) WHERE score > 1")
def boolean_search(spark, sf):
    """FLT16 FLT22: what must hold filters, what should hold adds to the score, and
    scores up to a threshold are dropped."""
    d = table(spark, sf, "documents")
    first = d.agg(F.min("source")).first()[0]
    must = [F.col("lang").isin("en", "de"), F.col("n_chars") >= 100, F.col("text").isNotNull()]
    should = [(F.col("source") == first, 2.0), (F.col("text").contains("on"), 1.0), (F.col("n_chars") > 2000, 0.5)]
    return TS.boolean_search(d, must, should, 1.0).select("doc_id", "score")


@query("score_explanation", f"WITH {texts._mlt} SELECT m.query, m.doc_id, w.term, h.tf::BIGINT AS query_tf, w.tf::BIGINT AS tf, round(w.idf, 6) AS idf, round(h.qw * w.w, 5) AS contribution FROM m JOIN (SELECT query, term, tf, qw FROM h) h ON h.query = m.query JOIN w ON w.doc_id = m.doc_id AND w.term = h.term WHERE m.rank <= 5")
def score_explanation(spark, sf):
    """TXT28: what each term adds to the score of the five best of each query."""
    p, i = texts.base(spark, sf)
    heavy = texts.heaviest(spark, sf, p, i)
    best = texts.retrieved(spark, sf, p, heavy, 5)
    return TS.explained(p, best, heavy, "doc_id").select("query", "doc_id", "term", "query_tf", "tf", F.round("idf", 6).alias("idf"), F.round("contribution", 5).alias("contribution"))


@query("positive_negative_arrays", "WITH p AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS pos FROM customer WHERE c_acctbal > 5000 GROUP BY 1), n AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS neg FROM customer WHERE c_acctbal < 0 GROUP BY 1) SELECT c_nationkey, len(pos)::INTEGER AS n_pos, array_to_string(pos || neg, ',') AS ids FROM p JOIN n USING (c_nationkey)")
def positive_negative_arrays(spark, sf):
    """JN9 SET3 AGG8: whole rows collected on either side, joined, concatenated. The
    arrays are the result: one row a group."""
    c = table(spark, sf, "customer")
    side = lambda rows, name: rows.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias(name))
    both = side(c.where("c_acctbal > 5000"), "pos").join(side(c.where("c_acctbal < 0"), "neg"), "c_nationkey")
    ids = F.transform(F.concat("pos", "neg"), lambda r: r["c_custkey"].cast("string"))
    return both.select("c_nationkey", F.size("pos").alias("n_pos"), F.array_join(ids, ",").alias("ids"))


_draws = "SELECT c_custkey, c_nationkey, unnest(range(1, 4))::INTEGER AS draw FROM customer WHERE c_acctbal > 0"
_pick = "(((d.c_custkey * 131 + d.draw) * 2654435761) % 4294967296)"


@query(
    "competitor_training",
    f"""
    WITH g AS (SELECT c_custkey AS other, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    s AS (SELECT c_custkey AS other, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    d AS ({_draws}), p AS (SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS other FROM customer WHERE c_acctbal > 0)
    SELECT c_custkey, other, 1 AS label FROM p WHERE other IS NOT NULL
    UNION ALL SELECT d.c_custkey, g.other, 0 FROM d JOIN g ON g.i = {_pick} % g.n
    UNION ALL SELECT d.c_custkey, s.other, 0 FROM d JOIN s ON s.c_nationkey = d.c_nationkey AND s.i = {_pick} % s.n
    """,
)
def competitor_training(spark, sf):
    """RNK12 JN8 JN11 ARR2: positives of the same place and segment, negatives of all and
    of the same place, drawn by a reproducible number."""
    c = table(spark, sf, "customer")
    base = c.where("c_acctbal > 0")
    after = F.lead("c_custkey").over(W.Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    pos = base.select("c_custkey", after.alias("other"), F.lit(1).alias("label")).where("other IS NOT NULL")
    pool = R.gapless_ids(c.select("c_custkey"), "c_custkey", "i").select(F.col("c_custkey").alias("other"), "i")
    glob = S.negatives(base, "c_custkey", pool, "i", c.count(), 3).select("c_custkey", "other", F.lit(0).alias("label"))
    own = S.negatives_within(base, "c_custkey", c.select(F.col("c_custkey").alias("other"), "c_nationkey"), "other", "c_nationkey", 3).select("c_custkey", "other", F.lit(0).alias("label"))
    return pos.unionByName(glob).unionByName(own)


@query("map_merge", "SELECT user_id, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2")
def map_merge(spark, sf):
    """AGG19: single entries merged to one map a user; its long form."""
    one = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = one.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("name", "n"))


@query("map_of_sets", "SELECT name, count(DISTINCT item) AS items, min(item) AS least FROM (SELECT p_brand AS name, p_type AS item FROM part UNION ALL SELECT p_brand, p_name FROM part WHERE p_size > 20) GROUP BY 1")
def map_of_sets(spark, sf):
    """SET6: two maps of lists as one map of sets."""
    p = table(spark, sf, "part")
    lists = [p.groupBy("p_brand").agg(F.collect_list("p_type").alias("l")), p.where("p_size > 20").groupBy("p_brand").agg(F.collect_list("p_name").alias("l"))]
    both = reduce(lambda a, b: a.unionByName(b), (x.select(F.col("p_brand").alias("name"), F.explode("l").alias("item")) for x in lists))
    return both.groupBy("name").agg(F.collect_set("item").alias("s")).select("name", F.size("s").cast("long").alias("items"), F.array_min("s").alias("least"))


@query("matrix_sum", "SELECT l_returnflag AS row, l_linestatus AS col, round(sum(l_quantity), 4) AS x FROM lineitem GROUP BY 1, 2")
def matrix_sum(spark, sf):
    """AGG28: a matrix for each order, added entry by entry; partial sums make the tree."""
    each = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("col")).agg(F.sum("l_quantity").alias("x"))
    return each.groupBy("row", "col").agg(F.round(F.sum("x"), 4).alias("x"))


@query("log_histogram", "WITH b AS (SELECT floor(log10(o_totalprice) * 4)::INTEGER AS bin FROM orders WHERE o_totalprice > 0), h AS (SELECT bin, count(*) AS n FROM b GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cdf, round(power(10, (bin - 3) / 4.0), 4) AS low, round(power(10, (bin + 1) / 4.0), 4) AS high FROM h")
def log_histogram(spark, sf):
    """AGG30: quarter decades, their share so far, and the range from three bins below to
    one above. Bins are few, whatever the rows."""
    h = table(spark, sf, "orders").where("o_totalprice > 0").groupBy(F.floor(F.log10("o_totalprice") * 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.Window.orderBy("bin")) / F.sum("n").over(W.Window.partitionBy())
    edge = lambda k: F.round(F.pow(F.lit(10.0), (F.col("bin") + k) / 4), 4)
    return h.select("bin", "n", F.round(so_far, 6).alias("cdf"), edge(-3).alias("low"), edge(1).alias("high"))


_yearly = "SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS val FROM orders GROUP BY 1, 2"


def yearly(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("val"))


@query("level_and_delta", f"WITH y AS ({_yearly}) SELECT entity, year, round(greatest(-200000, least(200000, val)), 2) AS level, CASE WHEN nxt IS NOT NULL THEN round(greatest(-200000, least(200000, nxt - val)), 2) END AS delta FROM (SELECT *, lead(val) OVER (PARTITION BY entity ORDER BY year) AS nxt FROM y)")
def level_and_delta(spark, sf):
    """WIN14"""
    out = series.level_delta(yearly(spark, sf), ["entity"], 200000.0)
    return out.select("entity", "year", F.round("level", 2).alias("level"), F.round("delta", 2).alias("delta"))


@query("aligned_series", f"WITH y AS ({_yearly}), m AS (SELECT max(year) AS last FROM y), e AS (SELECT DISTINCT entity FROM y) SELECT e.entity, o.k::INTEGER AS k, CASE WHEN y.val IS NULL THEN 1 ELSE 2 + (y.val >= -100000)::INT + (y.val >= 0)::INT + (y.val >= 100000)::INT END AS bucket FROM e CROSS JOIN (SELECT unnest(range(0, 4)) AS k) o CROSS JOIN m LEFT JOIN y ON y.entity = e.entity AND y.year = m.last - o.k")
def aligned_series(spark, sf):
    """WIN15 VEC13: the last four years from the newest of all, padded and quantised."""
    y = yearly(spark, sf)
    spine = y.select("entity").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(F.broadcast(y.agg(F.max("year").alias("last"))))
    both = spine.withColumn("year", F.col("last") - F.col("k")).join(y, ["entity", "year"], "left")
    return both.select("entity", "k", N.quantise(F.col("val"), [100000.0]).alias("bucket"))


@query("total_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders")
def total_order(spark, sf):
    """SRT2 SRT3: the place of each row in the whole order and in its entity's, newest
    first; the whole order is numbered in ranges."""
    w = W.Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("nth"))
    return R.gapless_ids(o, "o_orderkey", "at").select("o_orderkey", "at", "nth")


@query("most_disagreed", f"WITH a AS (SELECT doc_id // 3 AS item, rel FROM ({_a})) SELECT item, count(*) AS n, round(var_pop(rel), 6) AS spread FROM a GROUP BY 1 HAVING count(*) > 1 ORDER BY spread DESC, item LIMIT 20")
def most_disagreed(spark, sf):
    """SRT14: the items on which analysts differ most."""
    a = annotations(spark, sf).groupBy(F.floor(F.col("doc_id") / 3).alias("item")).agg(F.count("*").alias("n"), F.round(F.var_pop("rel"), 6).alias("spread"))
    return a.where("n > 1").orderBy(F.desc("spread"), "item").limit(20)


@query("relative_order", f"WITH a AS (SELECT doc_id // 3 AS item, doc_id, rel FROM ({_a})) SELECT x.item, x.doc_id AS doc_i, y.doc_id AS doc_j, x.rel >= y.rel AS at_least FROM a x JOIN a y ON x.item = y.item AND x.doc_id <> y.doc_id")
def relative_order(spark, sf):
    """ANN4: the matrix rel_i >= rel_j of an item; items have three documents at most."""
    a = annotations(spark, sf).select(F.floor(F.col("doc_id") / 3).alias("item"), "doc_id", "rel")
    x, y = a.select("item", F.col("doc_id").alias("doc_i"), F.col("rel").alias("ri")), a.select("item", F.col("doc_id").alias("doc_j"), F.col("rel").alias("rj"))
    return x.join(y, "item").where("doc_i <> doc_j").select("item", "doc_i", "doc_j", (F.col("ri") >= F.col("rj")).alias("at_least"))


@query("strict_inversions", f"WITH a AS (SELECT task, analyst, rel, row_number() OVER (PARTITION BY task, analyst ORDER BY n_chars DESC, doc_id) AS p FROM ({_a})) SELECT x.task, x.analyst, count(y.p) AS n, (count(*) FILTER (y.p IS NOT NULL) > 0) AS found FROM a x LEFT JOIN a y ON x.task = y.task AND x.analyst = y.analyst AND x.p < y.p AND x.rel = 0 AND y.rel >= 1 GROUP BY 1, 2")
def strict_inversions(spark, sf):
    """JN17: irrelevant documents ranked above relevant ones, counted by what follows."""
    hit = (F.col("rel") >= 1).cast("long")
    a = scanned(annotations(spark, sf), ["task", "analyst"], [F.col("n_chars"), -F.col("doc_id")], "back", {"later": hit})
    return a.groupBy("task", "analyst").agg(F.sum(F.when(F.col("rel") == 0, F.col("later")).otherwise(F.lit(0))).alias("n")).withColumn("found", F.col("n") > 0)


@query("hinge_loss", f"WITH a AS (SELECT doc_id // 3 AS item, rel, ln(n_chars + 1) AS s FROM ({_a})) SELECT count(*) AS pairs, round(avg(greatest(0, 1 - (x.s - y.s))), 6) AS hinge FROM a x JOIN a y ON x.item = y.item AND x.rel > y.rel")
def hinge_loss(spark, sf):
    """RNK11: mean hinge of the score differences of an item's preferences."""
    a = annotations(spark, sf).select(F.floor(F.col("doc_id") / 3).alias("item"), "rel", F.log1p("n_chars").alias("s"))
    x, y = a.withColumnsRenamed({"rel": "rx", "s": "sx"}), a.withColumnsRenamed({"rel": "ry", "s": "sy"})
    return x.join(y, "item").where("rx > ry").agg(F.count("*").alias("pairs"), F.round(F.avg(F.greatest(F.lit(0.0), 1 - (F.col("sx") - F.col("sy")))), 6).alias("hinge"))


@query("plain_names", "SELECT doc_id, lower(strip_accents(regexp_replace(substr(text, 1, 60), '[!-/:-@\\[-`{-~]', '', 'g'))) AS plain FROM documents WHERE regexp_full_match(substr(text, 1, 60), '[ -~àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]*')")
def plain_names(spark, sf):
    """STR2 STR3: names without case, marks and accents."""
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("s"))
    return d.where(F.col("s").rlike("^[ -~àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]*\\z")).select("doc_id", X.plain_name(F.col("s")).alias("plain"))


@query("industry_labels", "SELECT n_nationkey, CASE WHEN lower(n_name) = lower(r_name) THEN n_name ELSE concat_ws(' ', n_name, CASE WHEN r_regionkey < 3 THEN r_name END) END AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def industry_labels(spark, sf):
    """STR18: a label with its parent's where that differs; a missing one adds nothing."""
    parents = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.when(F.col("r_regionkey") < 3, F.col("r_name")).alias("parent"))
    n = table(spark, sf, "nation").join(F.broadcast(parents), "n_regionkey", "left")
    return n.select("n_nationkey", F.when(F.lower("n_name") == F.lower("parent"), F.col("n_name")).otherwise(F.concat_ws(" ", "n_name", "parent")).alias("label"))


@query("money_ranges", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 1e6 ELSE s_suppkey * 1e3 / 10 END AS low, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey + 3) * 1e9 ELSE s_suppkey * 1e3 * 10 END AS high FROM supplier")
def money_ranges(spark, sf):
    """STR21: ranges and single values with their units."""
    k = F.col("s_suppkey").cast("string")
    said = F.when(F.col("s_suppkey") % 2 == 0, F.concat(k, F.lit("m-"), (F.col("s_suppkey") + 3).cast("string"), F.lit("B"))).otherwise(F.concat(k, F.lit("K")))
    return table(spark, sf, "supplier").select("s_suppkey", X.money_range(said).alias("r")).select("s_suppkey", "r.low", "r.high")


@query("dequantised", "SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN '-inf - -500.0000' WHEN c_acctbal < 0 THEN '-500.0000 - 0.0000' WHEN c_acctbal < 500 THEN '0.0000 - 500.0000' ELSE '500.0000 - inf' END AS bounds FROM customer")
def dequantised(spark, sf):
    """VEC13 VEC14: the range that a value's bucket stands for."""
    return table(spark, sf, "customer").select("c_custkey", F.replace(N.dequantise(N.quantise(F.col("c_acctbal"), [500.0]), [500.0]), F.lit("Infinity"), F.lit("inf")).alias("bounds"))


_drawn = "((p_partkey * 131 + 7) * 2654435761) % 4294967296"


@query("drawn_rows", f"WITH d AS (SELECT p_partkey, p_brand, {_drawn} AS u FROM part) SELECT 'all' AS of, p_partkey FROM (SELECT p_partkey FROM d ORDER BY u, p_partkey LIMIT 50) UNION ALL SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY u, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM d) WHERE k <= 5 AND n >= 5")
def drawn_rows(spark, sf):
    """SMP3 SMP5: fifty rows of all and five of each brand that has so many, the ones with
    the least reproducible numbers."""
    u = F.pmod((F.col("p_partkey") * 131 + 7) * F.lit(2654435761), F.lit(4294967296))
    p = table(spark, sf, "part").select("p_partkey", "p_brand", u.alias("u"))
    enough = p.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 5").select("p_brand")
    own = R.top_k(p, ["p_brand"], [F.asc("u"), F.asc("p_partkey")], 5).join(enough, "p_brand", "left_semi")
    return p.orderBy("u", "p_partkey").limit(50).select(F.lit("all").alias("of"), "p_partkey").unionByName(own.select(F.col("p_brand").alias("of"), "p_partkey"))


@query("scenario_codes", "SELECT n_regionkey AS scenario, count(DISTINCT s_nationkey) AS codes, min(s_nationkey) AS least FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def scenario_codes(spark, sf):
    """FCS9: the set of codes of each scenario."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("scenario"))
    sets = table(spark, sf, "supplier").join(F.broadcast(n), "s_nationkey").groupBy("scenario").agg(F.collect_set("s_nationkey").alias("s"))
    return sets.select("scenario", F.size("s").cast("long").alias("codes"), F.array_min("s").alias("least"))


@query("qualified_sectors", f"WITH y AS ({_yearly}), q AS (SELECT entity, count(*) AS n FROM y WHERE val > 0 GROUP BY 1 HAVING count(*) >= 5) SELECT c_mktsegment AS sector, count(*) AS entities FROM q JOIN customer ON c_custkey = entity GROUP BY 1 HAVING count(*) >= 10")
def qualified_sectors(spark, sf):
    """FCS11: sectors with ten entities of five years, in one grouped query."""
    q = yearly(spark, sf).where("val > 0").groupBy("entity").agg(F.count("*").alias("n")).where("n >= 5")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    return q.join(c, "entity").groupBy("sector").agg(F.count("*").alias("entities")).where("entities >= 10")


@query("mean_convolution", "WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT s, avg(c_acctbal) AS h1 FROM e JOIN customer ON c = c_custkey GROUP BY 1), k AS (SELECT c, avg(h1) AS h2 FROM e JOIN h USING (s) GROUP BY 1) SELECT c_custkey, round(c_acctbal, 4) AS own, round(h2, 4) AS neighbours FROM customer LEFT JOIN k ON c = c_custkey")
def mean_convolution(spark, sf):
    """GRF1 GRF2: two hops of mean aggregation over the customer-supplier edges, beside
    the node's own value."""
    o, li, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s")).distinct()
    h = e.join(c.select("c_custkey", "c_acctbal"), "c_custkey").groupBy("s").agg(F.avg("c_acctbal").alias("h1"))
    k = e.join(h, "s").groupBy("c_custkey").agg(F.avg("h1").alias("h2"))
    return c.join(k, "c_custkey", "left").select("c_custkey", F.round("c_acctbal", 4).alias("own"), F.round("h2", 4).alias("neighbours"))


@query("meta_descriptions", r"""SELECT page_id, regexp_extract_all(html, '(?i)<meta[^>]*(?:name|property)="(?:og: ?)?description"[^>]*content="([^"]*)"', 1)[-1] AS description, nullif(regexp_extract(html, '(?i)<meta[^>]*charset="?([\w-]+)', 1), '') AS charset FROM pages""")
def meta_descriptions(spark, sf):
    """WEB1 WEB3: the last description of each page, null where it has none, and its charset."""
    charset = F.regexp_extract("html", r'(?i)<meta[^>]*charset="?([\w-]+)', 1)
    return table(spark, sf, "pages").select("page_id", web.meta_description(F.col("html")).alias("description"), F.nullif(charset, F.lit("")).alias("charset"))


_words = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


@query("shingle_counts", f"WITH w AS (SELECT doc_id AS item_id, string_split({_words}, ' ') AS w FROM documents), s AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS shingle FROM w, (SELECT unnest(range(2, 5)) AS n), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE i + n - 1 <= len(w)) SELECT n::INTEGER AS n, shingle, count(*) AS times, count(DISTINCT item_id) AS items FROM s GROUP BY 1, 2")
def shingle_counts(spark, sf):
    """ARR6: shingles of two to four words."""
    b = texts.spread_texts(spark, sf).select(F.col("doc_id").alias("item_id"), F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ").alias("w"))
    return TS.shingle_counts(b, "item_id", "w", (2, 3, 4))


@query("stem_shingles")
def stem_shingles(spark, sf):
    """TXT16: shingles of two to four stems of the English documents, as an analyser makes them."""
    d = texts.spread_texts(spark, sf).where("lang = 'en'")
    return TS.shingle_counts(d.select("doc_id", stem.stems(X.terms(F.col("text"))).alias("w")), "doc_id", "w", (2, 3, 4))


@query("magnitudes", "SELECT p_partkey, round(p_retailprice * CASE p_size % 6 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e6 WHEN 3 THEN 1e3 ELSE 1 END, 2)::DOUBLE AS amount FROM part")
def magnitudes(spark, sf):
    """MTH5: amounts with the magnitudes b, m, mn, k, none and an unknown one."""
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "m", "mn", "K", None, "x"))), F.col("p_size") % 6 + 1)
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * N.magnitude(unit), 2).alias("amount"))


@query("drawn_index", "SELECT o_orderkey, floor(((o_orderkey * 2654435761) % 4294967296) / 4294967296.0 * 25)::BIGINT AS i FROM orders")
def drawn_index(spark, sf):
    """MTH3: a reproducible number in [0, 1) times n, cut."""
    u = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296.0)
    return table(spark, sf, "orders").select("o_orderkey", F.floor(u * 25).alias("i"))


@query("orders_as_json", "SELECT o_custkey, to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS orders FROM orders GROUP BY 1")
def orders_as_json(spark, sf):
    """JSN2: an array of structs as JSON."""
    o = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(o).alias("orders"))


@query("arrays_and_maps", "SELECT n_nationkey, n_regionkey::BIGINT AS second, n_name AS named, 2::INTEGER AS entries FROM nation")
def arrays_and_maps(spark, sf):
    """ARR3: an array and a map made of columns, and their elements."""
    n = table(spark, sf, "nation").withColumns({"a": F.array("n_nationkey", "n_regionkey"), "m": F.create_map(F.lit("name"), F.col("n_name"), F.lit("comment"), F.lit("none"))})
    return n.select("n_nationkey", F.col("a")[1].cast("long").alias("second"), F.col("m")["name"].alias("named"), F.size("m").alias("entries"))


_words = "WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM part), i AS (SELECT term, ln(n / df) AS idf FROM f, n WHERE df < n / 5)"


@query("tf_left_idf", f"{_words} SELECT p_partkey, t.term, round(coalesce(idf, 0), 6) AS idf FROM t LEFT JOIN i USING (term)")
def tf_left_idf(spark, sf):
    """JN12: terms beside their idf, 0 for those that are too frequent to have one."""
    t, i = _part_terms(spark, sf)
    return t.join(i, "term", "left").select("p_partkey", "term", F.round(F.coalesce("idf", F.lit(0.0)), 6).alias("idf"))


@query("binary_idf_vectors", f"{_words}, v AS (SELECT term, idf, row_number() OVER (ORDER BY term) - 1 AS i FROM i) SELECT p_partkey, i, round(idf, 6) AS idf FROM t JOIN v USING (term)")
def binary_idf_vectors(spark, sf):
    """TXT5 TXT6: the idf of each term of the vocabulary that a name has, however often, at
    the term's place in the sorted vocabulary."""
    t, i = _part_terms(spark, sf)
    v = scanned(i, [], [F.col("term")], "place")
    return t.join(v, "term").select("p_partkey", (F.col("place") - 1).alias("i"), F.round("idf", 6).alias("idf"))


def _part_terms(spark, sf):
    """(p_partkey, term) and the vocabulary of terms in less than a fifth of the names."""
    p = table(spark, sf, "part")
    t = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"))
    n = p.agg(F.count("*").alias("n"))
    i = t.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(F.col("df") < F.col("n") / 5)
    return t, i.select("term", F.log(F.col("n") / F.col("df")).alias("idf"))


@query(
    "unique_names",
    """
    WITH q AS (SELECT p_partkey AS query, lower(p_name) AS name, p_size AS size FROM part), c AS (SELECT p_partkey, lower(p_name) AS name, p_size AS size FROM part),
    s AS (SELECT q.query, c.p_partkey AS found, levenshtein(q.name, c.name) AS edits FROM q JOIN c ON q.size = c.size AND q.query <> c.p_partkey)
    SELECT query, CASE WHEN min(edits) <= 2 THEN arg_min(found, (edits, found)) END AS found, count(*) FILTER (edits = 0) AS exact, count(*) FILTER (edits = 0) > 1 AS ambiguous FROM s GROUP BY 1
    """,
)
def unique_names(spark, sf):
    """TXT18: for each part the nearest other name of the same size if it is at most two edits
    away, and whether several are the very name."""
    c = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_size")
    return TS.nearest_names(c, c, "p_partkey", "name", "p_size")
