"""Financial facts: restatements, currency, series, forecasts, formulas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import numbers as N
from ..operators import forecast as FC
from ..operators import formula as FM
from ..operators import relational as R
from ..operators import series as S
from ..sources.io import table
from .registry import query

#: Items of the facts: order priority -> mnemonic.
ITEMS = {"1-URGENT": "revenue", "2-HIGH": "ebitda", "3-MEDIUM": "debt", "4-NOT SPECIFIED": "cash", "5-LOW": "assets"}
_items = ", ".join(f"('{k}', '{v}')" for k, v in ITEMS.items())
#: The facts, one row a restatement, latest first: the SQL of ``facts``.
_facts = f"""
    SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS year, m.mnemonic, o_totalprice AS val, o_orderkey, o_orderstatus AS prio, o_orderdate AS reported
    FROM orders JOIN (VALUES {_items}) m(item, mnemonic) ON o_orderpriority = m.item
"""
_latest = f"SELECT entity, year, mnemonic, val, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, mnemonic ORDER BY prio DESC, reported DESC, o_orderkey DESC) AS rn FROM ({_facts})) WHERE rn = 1"


def item_map(spark):
    """DIM table of ITEMS: five rows."""
    return spark.createDataFrame(list(ITEMS.items()), "item string, mnemonic string")


def facts(spark, sf):
    """JN1: orders as facts (entity, year, mnemonic, val)."""
    o = table(spark, sf, "orders")
    m = F.broadcast(item_map(spark))
    return o.join(m, o.o_orderpriority == m.item).select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), "mnemonic", F.col("o_totalprice").alias("val"), "o_orderkey", F.col("o_orderstatus").alias("prio"), F.col("o_orderdate").alias("reported"))


def latest(spark, sf):
    """WIN1: the latest restatement of each (entity, year, item)."""
    return R.first_by(facts(spark, sf), ["entity", "year", "mnemonic"], [F.struct("prio", "reported", "o_orderkey").desc()]).select("entity", "year", "mnemonic", "val", "o_orderkey")


@query("latest_restatement", f"SELECT entity, year, mnemonic, round(val, 2) AS val, o_orderkey FROM ({_latest})")
def latest_restatement(spark, sf):
    """WIN1 WIN9 JN1 DAT1"""
    return latest(spark, sf).withColumn("val", F.round("val", 2))


@query(
    "item_map_fx_join",
    f"""
    SELECT f.o_orderkey, f.mnemonic, n.n_name, round(f.val * (1 + n.n_nationkey / 100.0), 4)::DOUBLE AS usd
    FROM ({_facts}) f JOIN customer c ON f.entity = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey <> 3 AND f.mnemonic IN ('revenue', 'ebitda')
    """,
)
def item_map_fx_join(spark, sf):
    """JN1 JN2 JN14 SRC10 SRC11: facts of two items in one currency; facts without a
    rate are dropped."""
    rates = table(spark, sf, "nation").where("n_nationkey <> 3").select("n_nationkey", "n_name", (1 + F.col("n_nationkey") / 100.0).alias("rate"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    f = facts(spark, sf).where(F.col("mnemonic").isin("revenue", "ebitda"))
    out = f.join(c, f.entity == c.c_custkey).join(rates, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select("o_orderkey", "mnemonic", "n_name", F.round(F.col("val") * F.col("rate"), 4).alias("usd"))


@query(
    "left_optional_financials",
    f"""
    WITH l AS (SELECT entity, year, mnemonic, val FROM ({_latest}) WHERE year = 1998 AND mnemonic = 'revenue'),
    p AS (SELECT c_custkey AS base, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS peer FROM customer)
    SELECT p.base, p.peer, round(b.val, 2) AS base_val, round(q.val, 2) AS peer_val FROM p JOIN l b ON b.entity = p.base LEFT JOIN l q ON q.entity = p.peer WHERE p.peer IS NOT NULL
    """,
)
def left_optional_financials(spark, sf):
    """JN3 JN4: base facts required, peer facts optional."""
    facts_ = latest(spark, sf).where("year = 1998 AND mnemonic = 'revenue'").select("entity", "val")
    w = W.Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("base"), F.lead("c_custkey").over(w).alias("peer")).where("peer IS NOT NULL")
    b, q = facts_.toDF("base", "base_val"), facts_.toDF("peer", "peer_val")
    return p.join(b, "base").join(q, "peer", "left").select("base", "peer", F.round("base_val", 2).alias("base_val"), F.round("peer_val", 2).alias("peer_val"))


@query(
    "nearest_year_asof",
    f"""
    WITH l AS (SELECT entity, year, val FROM ({_latest}) WHERE mnemonic = 'revenue' AND val <> 0 AND year >= 1995),
    b AS (SELECT entity, max(year) AS year, arg_max(val, year) AS val FROM l GROUP BY 1),
    p AS (SELECT c_custkey AS base, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS peer FROM customer),
    r AS (SELECT p.base, p.peer, b.year AS base_year, q.year AS peer_year, q.val, row_number() OVER (PARTITION BY p.base, p.peer ORDER BY abs(b.year - q.year), q.year) AS rn FROM p JOIN b ON b.entity = p.base JOIN l q ON q.entity = p.peer)
    SELECT base, peer, base_year, peer_year, round(val, 2) AS peer_val FROM r WHERE rn = 1
    """,
)
def nearest_year_asof(spark, sf):
    """JN22 JN23: of each pair the peer's year closest to the base's last."""
    own = latest(spark, sf).where("mnemonic = 'revenue'").select("entity", "year", "val")
    b = R.last_reported(own, ["entity"], 1995)
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("base"), F.lead("c_custkey").over(W.Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("peer")).where("peer IS NOT NULL")
    base = p.join(b.withColumnRenamed("entity", "base"), "base")
    out = R.nearest_year(base, own.withColumnRenamed("entity", "peer"), ["peer"], 1995)
    return out.select("base", "peer", "base_year", "peer_year", F.round("peer_val", 2).alias("peer_val"))


@query("last_reported", f"SELECT entity, mnemonic, max(year) AS year, round(arg_max(val, year), 2) AS val FROM ({_latest}) WHERE val <> 0 AND year >= 1996 GROUP BY 1, 2")
def last_reported(spark, sf):
    """JN23"""
    return R.last_reported(latest(spark, sf), ["entity", "mnemonic"], 1996).withColumn("val", F.round("val", 2))


@query(
    "common_years",
    f"""
    WITH y AS (SELECT entity, year, count(DISTINCT mnemonic) AS items FROM ({_latest}) GROUP BY 1, 2 HAVING count(DISTINCT mnemonic) >= 2), n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM y)
    SELECT entity, year, items, nth FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year) AS nth FROM n WHERE k <= 20) WHERE nth <= 3
    """,
)
def common_years(spark, sf):
    """JN24 WIN10 WIN12"""
    return S.common_years(latest(spark, sf), "entity", "mnemonic", 2).select("entity", "year", "items", "nth")


@query("nested_series", f"SELECT entity, mnemonic, year, round(val, 2) AS val, (last - year)::BIGINT AS back FROM (SELECT *, max(year) OVER (PARTITION BY entity, mnemonic) AS last FROM ({_latest}))")
def nested_series(spark, sf):
    """AGG7 WIN15 ARR1: series nested by entity and item, and unnested with the
    distance to their last year."""
    nested = latest(spark, sf).groupBy("entity", "mnemonic").agg(F.sort_array(F.collect_list(F.struct("year", "val"))).alias("s"))
    return S.right_aligned(nested.select("entity", "mnemonic", F.inline("s")), ["entity", "mnemonic"]).select("entity", "mnemonic", "year", F.round("val", 2).alias("val"), F.col("offset").alias("back"))


_annual = f"SELECT entity, year, sum(val) AS val FROM ({_latest}) GROUP BY 1, 2"


def annual(spark, sf):
    return latest(spark, sf).groupBy("entity", "year").agg(F.sum("val").alias("val"))


_growth = f"SELECT entity, year, val, greatest(-1.0, least(1.0, round((val - p) / nullif(p, 0), 3))) AS growth FROM (SELECT *, lag(val) OVER (PARTITION BY entity ORDER BY year) AS p FROM ({_annual}))"


@query("growth_rates", f"SELECT entity, year, CASE WHEN p IS NULL OR p = 0 THEN NULL ELSE greatest(-1.0, least(1.0, round((val - p) / p, 3))) END AS growth FROM (SELECT *, lag(val) OVER (PARTITION BY entity ORDER BY year) AS p FROM ({_annual}))")
def growth_rates(spark, sf):
    """WIN8: null for the first year."""
    g = S.growth(annual(spark, sf), ["entity"])
    return g.select("entity", "year", F.when(F.lag("val").over(W.Window.partitionBy("entity").orderBy("year")).isNotNull(), F.col("growth")).alias("growth"))


@query(
    "yoy_transform",
    f"""
    WITH a AS (SELECT entity, year, val - 100000 AS val, lag(val - 100000) OVER (PARTITION BY entity ORDER BY year) AS p FROM ({_annual})),
    c AS (SELECT entity, year, CASE WHEN p > 0 AND val > 0 THEN (val - p) / p WHEN p < 0 AND val < 0 THEN (p - val) / p WHEN p <= 0 AND val >= 0 THEN 1.0 WHEN p >= 0 AND val <= 0 THEN -1.0 END AS ch FROM a)
    SELECT entity, year, CASE WHEN ch IS NULL THEN NULL ELSE round(1 / (1 + exp(-pow(greatest(-5.0, least(5.0, ch)), 3))), 6) END AS squashed FROM c
    """,
)
def yoy_transform(spark, sf):
    """WIN13 WIN14"""
    a = annual(spark, sf).withColumn("val", F.col("val") - 100000)
    return S.yoy(a, ["entity"]).select("entity", "year", F.when(F.col("change").isNotNull(), F.col("squashed")).alias("squashed"))


@query(
    "band_normalise",
    """
    SELECT o_orderkey, round(CASE WHEN v < 0 THEN 0.0 WHEN v < 1e2 THEN v / 1e2 * 0.1 WHEN v < 1e3 THEN (v - 1e2) / (1e3 - 1e2) * 0.1 + 0.1 WHEN v < 1e4 THEN (v - 1e3) / (1e4 - 1e3) * 0.1 + 0.2 WHEN v < 1e5 THEN (v - 1e4) / (1e5 - 1e4) * 0.1 + 0.3
      WHEN v < 1e6 THEN (v - 1e5) / (1e6 - 1e5) * 0.1 + 0.4 WHEN v < 1e7 THEN (v - 1e6) / (1e7 - 1e6) * 0.1 + 0.5 ELSE 1.0 END, 3)::DOUBLE AS band, round(CASE WHEN v / 1e6 BETWEEN 0 AND 1 THEN 1 - v / 1e6 ELSE 0 END, 3)::DOUBLE AS nde, round(CASE WHEN v / 1e3 BETWEEN 0 AND 100 THEN (100 - v / 1e3) / 100 ELSE 0 END, 3)::DOUBLE AS tde
    FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)
    """,
)
def band_normalise(spark, sf):
    """MTH9 MTH10"""
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(N.band(v), 3).alias("band"), F.round(N.nde_scale(v / 1e6), 3).alias("nde"), F.round(N.tde_scale(v / 1e3), 3).alias("tde"))


_sector = f"SELECT c.c_mktsegment AS sector, a.entity, a.year, a.val FROM ({_annual}) a JOIN customer c ON c.c_custkey = a.entity"


def by_sector(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    return annual(spark, sf).join(c, "entity")


@query(
    "sector_curve_imputed",
    f"""
    WITH s AS ({_sector}), e AS (SELECT DISTINCT sector, entity FROM s), y AS (SELECT unnest(range(1996, 2001))::INTEGER AS year), o AS (SELECT entity, avg(val) AS own FROM s WHERE val <> 0 GROUP BY 1)
    SELECT e.sector, y.year, round(avg(coalesce(nullif(s.val, 0), o.own)), 4) AS avg_val FROM e CROSS JOIN y LEFT JOIN s ON s.entity = e.entity AND s.year = y.year LEFT JOIN o ON o.entity = e.entity GROUP BY 1, 2
    """,
)
def sector_curve_imputed(spark, sf):
    """AGG32 SRC9: dense years, missing values as the entity's mean."""
    return S.sector_average(by_sector(spark, sf), "sector", "entity", 1996, 2000)


@query("sector_curve", f"WITH g AS (SELECT s.sector, s.entity, s.year, CASE WHEN p IS NULL OR p = 0 THEN NULL ELSE greatest(-1.0, least(1.0, round((val - p) / p, 3))) END AS growth FROM (SELECT *, lag(val) OVER (PARTITION BY entity ORDER BY year) AS p FROM ({_sector})) s), k AS (SELECT entity FROM g WHERE growth IS NOT NULL GROUP BY 1 HAVING count(DISTINCT growth) > 1) SELECT sector, year, round(avg(growth), 4) AS curve FROM g WHERE growth IS NOT NULL AND entity IN (SELECT entity FROM k) GROUP BY 1, 2")
def sector_curve(spark, sf):
    """AGG33 FCS1"""
    g = S.growth(by_sector(spark, sf), ["entity"])
    g = g.withColumn("first", F.min("year").over(W.Window.partitionBy("entity"))).where("year > first AND growth IS NOT NULL")
    return S.curves(g, "sector", "entity", "year", "growth", places=4)


_sgrowth = f"SELECT sector, entity, year, val, greatest(-1.0, least(1.0, round((val - p) / p, 3))) AS growth FROM (SELECT *, lag(val) OVER (PARTITION BY entity ORDER BY year) AS p FROM ({_sector})) WHERE p IS NOT NULL AND p <> 0"


def sector_growth(spark, sf):
    g = S.growth(by_sector(spark, sf), ["entity"])
    before = F.lag("val").over(W.Window.partitionBy("entity").orderBy("year"))
    return g.withColumn("b", before).where("b IS NOT NULL AND b <> 0").drop("b")


@query(
    "growth_category",
    f"WITH m AS (SELECT sector, entity, avg(growth) AS mean FROM ({_sgrowth}) GROUP BY 1, 2), r AS (SELECT *, min(mean) OVER (PARTITION BY sector) AS lo, max(mean) OVER (PARTITION BY sector) AS hi FROM m) SELECT sector, entity, round(mean, 6) AS mean, CASE WHEN mean <= lo + (hi - lo) / 4 THEN 'red' WHEN mean >= hi - (hi - lo) / 4 THEN 'green' ELSE 'blue' END AS category FROM r",
)
def growth_category(spark, sf):
    """FCS7 FCS10"""
    return S.growth_category(sector_growth(spark, sf), "entity", "sector").withColumn("mean", F.round("mean", 6))


@query(
    "backtest_error",
    f"""
    WITH g AS ({_sgrowth}), c AS (SELECT sector, year, avg(growth) AS curve FROM g GROUP BY 1, 2)
    SELECT g.sector, g.year, count(*) AS n, round(avg(abs(g.growth - c.curve)), 6) AS abs_error, round(avg(abs(CASE WHEN g.growth = 0 THEN 0.01 ELSE g.growth END - c.curve) / abs(CASE WHEN g.growth = 0 THEN 0.01 ELSE g.growth END)), 4) AS rel_error FROM g JOIN c USING (sector, year) GROUP BY 1, 2
    """,
)
def backtest_error(spark, sf):
    """FCS6 FCS8: growth against the sector's curve."""
    g = sector_growth(spark, sf)
    c = g.groupBy("sector", "year").agg(F.avg("growth").alias("curve"))
    gap = F.abs(F.col("growth") - F.col("curve"))
    return g.join(c, ["sector", "year"]).groupBy("sector", "year").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("abs_error"), F.round(F.avg(S.forecast_error(F.col("growth"), F.col("curve"))), 4).alias("rel_error"))


#: Growth in thousandths, and means of it by year in units of a curve, from whole numbers.
_g = f"SELECT sector, entity, year, floor(growth * 1000 + 0.5) AS g FROM ({_sgrowth})"
_fine, _unit = "floor((2000 * sum(g) + count(*)) / (2 * count(*)))", "floor((20 * sum(g) + count(*)) / (2 * count(*)))"
_curve = f"SELECT sector, year, {_fine} AS y FROM ({_g}) GROUP BY 1, 2"
_sums = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, arg_max(x, year) AS last, arg_max(y, year) AS beside"


def _grid(state: str, keys: str, grid: FC.Grid, low: str, high: str, ny: str = "ny", near: str = "last", fallback: str = "NULL") -> str:
    """The whole grid: a row for every candidate of every series."""
    low, high = f"({low})", f"({high})"
    old = f"floor((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) * {10**grid.places} + 0.5)"
    new = f"floor((((n + 1) * {ny} - sy - {ny}) * k + (n + 1) * sxy - sx * (sy + {ny})) / sqrt((n * k * k - 2 * sx * k + (n + 1) * sxx - sx * sx) * dy) * {10**grid.places} + 0.5)"
    return f"""
        SELECT s.*, coalesce(forecast, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 AND {ny} IS NOT NULL AND {high} > {low} THEN {fallback} END) AS forecast FROM ({state}) s LEFT JOIN (
            SELECT {keys}, arg_min(k, (abs(change) * {grid.weight} + abs(k - near), k)) AS forecast FROM (
                SELECT *, {new} - old AS change FROM (
                    SELECT *, {old} AS old, (n + 1) * (syy + {ny} * {ny}) - (sy + {ny}) * (sy + {ny}) AS dy, {near} AS near, {low} + {grid.step} * unnest(range(0, ceil(({high} - {low}) / {grid.step})::BIGINT)) AS k
                    FROM ({state}) WHERE n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
                ) WHERE dy > 0 AND n * k * k - 2 * sx * k + (n + 1) * sxx - sx * sx > 0
            ) WHERE change BETWEEN -{grid.tolerance} AND {grid.tolerance - 1} GROUP BY ALL
        ) b USING ({keys})
    """


def _grown(found: str, keys: str, ny: str, rest: str) -> str:
    """States with their forecast as a further place."""
    x = "coalesce(forecast, 0)"
    given = "(forecast IS NOT NULL)::INT"
    return f"SELECT {keys}, n + {given} AS n, sx + {x} AS sx, sy + {given} * {ny} AS sy, sxx + {x} * {x} AS sxx, syy + {given} * {ny} * {ny} AS syy, sxy + {x} * {ny} AS sxy, coalesce(forecast, last) AS last, CASE WHEN forecast IS NULL THEN beside ELSE {ny} END AS beside, forecast AS first, {rest} FROM ({found})"


def in_thousandths(spark, sf):
    return sector_growth(spark, sf).select("sector", "entity", "year", FC.units("growth", 1000).alias("g"))


def mean_units(to_one: int):
    """The mean of ``g`` in units, to the nearest, from whole numbers."""
    n = F.count("*")
    return F.floor((2 * to_one / 1000 * F.sum("g") + n) / (2 * n)).cast("double")


def curve_of(g, *by):
    return g.groupBy(*by, "year").agg(mean_units(FC.FINE).alias("y"))


_paired = f"SELECT entity, sector, year, 10 * g AS x, y FROM ({_g}) JOIN ({_curve}) USING (sector, year)"
_state = f"SELECT entity, {_sums}, any_value(ny) AS ny FROM ({_paired}) JOIN (SELECT sector, y AS ny FROM ({_curve}) WHERE year = 2000) USING (sector) WHERE year < 2000 GROUP BY 1"


@query("corr_forecast", f"SELECT entity, forecast / 10000 AS forecast FROM ({_grid(_state, 'entity', FC.SECTOR, 'greatest(last - 3000, 0)', 'least(last + 3000, 17000)')})")
def corr_forecast(spark, sf):
    """FCS2 AGG34: the year 2000 from the years before, beside the sector's curve."""
    g = in_thousandths(spark, sf)
    c = curve_of(g, "sector")
    s = g.where("year < 2000").join(c, ["sector", "year"]).groupBy("entity", "sector").agg(*FC.sums(10 * F.col("g"), F.col("y"), F.col("year")))
    s = s.join(c.where("year = 2000").select("sector", F.col("y").alias("ny")), "sector")
    return FC.next_value(s, "ny", FC.SECTOR).select("entity", (F.col("forecast") / FC.UNIT).alias("forecast"))


_category = f"SELECT sector, entity, CASE WHEN mean <= lo + (hi - lo) / 4 THEN 'red' WHEN mean >= hi - (hi - lo) / 4 THEN 'green' ELSE 'blue' END AS category FROM (SELECT *, min(mean) OVER (PARTITION BY sector) AS lo, max(mean) OVER (PARTITION BY sector) AS hi FROM (SELECT sector, entity, avg(growth) AS mean FROM ({_sgrowth}) GROUP BY 1, 2))"
_in_category = f"SELECT * FROM ({_g}) JOIN ({_category}) USING (sector, entity)"
_cstate = f"""
    SELECT sector, category, {_sums}, any_value(ny1) AS ny1, any_value(ny2) AS ny2, any_value(near) AS nr
    FROM (SELECT sector, category, year, {_unit} AS x FROM ({_in_category}) GROUP BY 1, 2, 3) JOIN ({_curve}) USING (sector, year)
    JOIN (SELECT sector, max(y) FILTER (year = 2000) AS ny1, max(y) FILTER (year = 2001) AS ny2, max(floor(y / 100 + 0.5)) FILTER (year = 2001) AS near FROM ({_curve}) GROUP BY 1) USING (sector)
    WHERE year < 2000 GROUP BY 1, 2
"""


def _moved(ny: str) -> str:
    return f"CASE WHEN beside < {ny} THEN last + 3000 ELSE last - 3000 END"


_c1 = _grown(_grid(_cstate, "sector, category", FC.CATEGORY, "last - 3000", "last + 3000", "ny1", "nr", _moved("ny1")), "sector, category", "ny1", "ny2, nr")
_c2 = _grid(_c1, "sector, category", FC.CATEGORY, "last - 3000", "last + 3000", "ny2", "nr", _moved("ny2"))


@query("category_forecast", f"SELECT sector, category, 2000 + i AS year, CASE i WHEN 0 THEN first ELSE forecast END / 10000 AS forecast FROM ({_c2}), (SELECT unnest([0, 1]) AS i)")
def category_forecast(spark, sf):
    """FCS3: the years 2000 and 2001 of each growth category's curve beside its sector's,
    the first a place of the series for the second; nearness is to the sector's last value,
    and where no candidate keeps the correlation the window's end to which the sector moves."""
    g = in_thousandths(spark, sf)
    own = g.join(S.growth_category(sector_growth(spark, sf), "entity", "sector").select("sector", "entity", "category"), ["sector", "entity"])
    c = curve_of(g, "sector")
    x = own.groupBy("sector", "category", "year").agg(mean_units(FC.UNIT).alias("x"))
    s = x.where("year < 2000").join(c, ["sector", "year"]).groupBy("sector", "category").agg(*FC.sums(F.col("x"), F.col("y"), F.col("year")))
    of = lambda year: F.max(F.when(F.col("year") == year, F.col("y")))
    s = s.join(c.groupBy("sector").agg(of(2000).alias("ny1"), of(2001).alias("ny2")), "sector")
    found = FC.rolled(s, ["ny1", "ny2"], FC.CATEGORY, F.floor(F.col("ny2") / 100 + 0.5).cast("double"), by_direction=True)
    return found.select("sector", "category", F.posexplode(F.array("forecast_1", "forecast_2")).alias("i", "f")).select("sector", "category", (F.col("i") + 2000).alias("year"), (F.col("f") / FC.UNIT).alias("forecast"))


_kinds = f"SELECT entity, sector, category, year, 10 * g AS x, y, 'category' AS kind FROM ({_in_category}) JOIN (SELECT sector, category, year, {_fine} AS y FROM ({_in_category}) GROUP BY 1, 2, 3) USING (sector, category, year) UNION ALL SELECT entity, sector, category, year, 10 * g, y, 'sector' FROM ({_in_category}) JOIN ({_curve}) USING (sector, year)"
_next = f"SELECT sector, category, year AS target, {_fine} AS ny, 'category' AS kind FROM ({_in_category}) GROUP BY 1, 2, 3 UNION ALL SELECT sector, category, year, y, 'sector' FROM ({_curve}) JOIN (SELECT DISTINCT sector, category FROM ({_category})) USING (sector)"
_bstate = f"SELECT entity, category, target, kind, {_sums}, any_value(ny) AS ny FROM ({_kinds}) k JOIN ({_next}) nx USING (sector, category, kind) WHERE target IN (2000, 2001) AND year < target GROUP BY 1, 2, 3, 4"


@query("borrower_forecast", f"SELECT entity, category, target::INTEGER AS year, max(forecast) FILTER (kind = 'category') / 10000 AS by_category, max(forecast) FILTER (kind = 'sector') / 10000 AS by_sector FROM ({_grid(_bstate, 'entity, category, target, kind', FC.BORROWER, 'last - 80000', 'last + 85000')}) GROUP BY 1, 2, 3")
def borrower_forecast(spark, sf):
    """FCS4: the growth of each entity in 2000 and 2001 from its years before, beside the
    curve of its growth category and that of its sector."""
    own = in_thousandths(spark, sf).join(S.growth_category(sector_growth(spark, sf), "entity", "sector").select("sector", "entity", "category"), ["sector", "entity"])
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    by_category = kind(curve_of(own, "sector", "category"), "category")
    by_sector = kind(curve_of(own, "sector").join(own.select("sector", "category").distinct(), "sector"), "sector")
    curves = by_category.unionByName(by_sector)
    rows = own.join(curves, ["sector", "category", "year"]).select("*", F.explode(F.filter(F.array(F.lit(2000), F.lit(2001)), lambda t: t > F.col("year"))).alias("target"))
    s = rows.groupBy("entity", "sector", "category", "kind", "target").agg(*FC.sums(10 * F.col("g"), F.col("y"), F.col("year")))
    s = s.join(curves.select("sector", "category", "kind", F.col("year").alias("target"), F.col("y").alias("ny")), ["sector", "category", "kind", "target"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("forecast") / FC.UNIT)).alias(f"by_{k}")
    return FC.next_value(FC.evenly(s), "ny", FC.BORROWER).groupBy("entity", "category", F.col("target").cast("int").alias("year")).agg(of("category"), of("sector"))


_rstate = f"SELECT entity, {_sums}, any_value(ny1) AS ny1, any_value(ny2) AS ny2 FROM ({_paired}) JOIN (SELECT sector, floor((y0 + y1) / 2) AS ny1, floor((floor((y0 + y1) / 2) + y1) / 2) AS ny2 FROM (SELECT sector, max(y) FILTER (year = 2000) AS y0, max(y) FILTER (year = 2001) AS y1 FROM ({_curve}) GROUP BY 1)) USING (sector) GROUP BY 1"
_rlow, _rhigh = "(CASE WHEN last <= 0 THEN -30000 ELSE last - 40000 END)", "least(last + 3000, 30000)"
_r2 = _grid(_grown(_grid(_rstate, "entity", FC.AHEAD, _rlow, _rhigh, "ny1"), "entity", "ny1", "ny2"), "entity", FC.AHEAD, _rlow, _rhigh, "ny2")


@query("rolled_forward", f"SELECT entity, 2002 + i AS year, CASE i WHEN 0 THEN first ELSE forecast END / 10000 AS forecast FROM ({_r2}), (SELECT unnest([0, 1]) AS i)")
def rolled_forward(spark, sf):
    """FCS5: two years beyond the data for each entity, the sector's growth given (the mean
    of its last two years, then of that and its last), each a place of the series for the next."""
    g = in_thousandths(spark, sf)
    c = curve_of(g, "sector")
    s = g.join(c, ["sector", "year"]).groupBy("entity", "sector").agg(*FC.sums(10 * F.col("g"), F.col("y"), F.col("year")))
    of = lambda year: F.max(F.when(F.col("year") == year, F.col("y")))
    mean = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("double")
    ahead = c.groupBy("sector").agg(of(2000).alias("y0"), of(2001).alias("y1")).withColumn("ny1", mean("y0", "y1")).withColumn("ny2", mean("ny1", "y1")).drop("y0", "y1")
    found = FC.rolled(FC.evenly(s.join(ahead, "sector")), ["ny1", "ny2"], FC.AHEAD)
    return found.select("entity", F.posexplode(F.array("forecast_1", "forecast_2")).alias("i", "f")).select("entity", (F.col("i") + 2002).alias("year"), (F.col("f") / FC.UNIT).alias("forecast"))


@query("sector_correlation", f"SELECT sector, round(corr(val, growth), 6) AS corr, round(stddev_pop(growth), 6) AS sd, round(var_pop(growth), 6) AS var, count(*) AS n FROM ({_sgrowth}) GROUP BY 1")
def sector_correlation(spark, sf):
    """AGG34 AGG35"""
    return sector_growth(spark, sf).groupBy("sector").agg(F.round(F.corr("val", "growth"), 6).alias("corr"), F.round(F.stddev_pop("growth"), 6).alias("sd"), F.round(F.var_pop("growth"), 6).alias("var"), F.count("*").alias("n"))


@query("entity_summary", f"SELECT entity, count(*) AS n, min(year) AS first_year, max(year) AS last_year, round(min(val), 2) AS low, round(max(val), 2) AS high, trunc(avg(val))::BIGINT AS mean FROM ({_annual}) GROUP BY 1")
def entity_summary(spark, sf):
    """AGG31: amounts are added as decimals, so that a mean that is a whole number is not cut
    to the one below."""
    a = latest(spark, sf).groupBy("entity", "year").agg(F.sum(F.col("val").cast("decimal(28,8)")).alias("val"))
    amount = lambda c: F.round(c.cast("double"), 2)
    s = a.groupBy("entity").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), amount(F.min("val")).alias("low"), amount(F.max("val")).alias("high"), F.sum("val").alias("_sum"), F.nullif(F.count("val"), F.lit(0)).alias("_of"))
    return s.withColumn("mean", F.expr("_sum div _of")).drop("_sum", "_of")


@query("exact_year_frame", f"SELECT entity FROM ({_annual}) GROUP BY 1 HAVING list_sort(list(DISTINCT year)) = [1995, 1996, 1997, 1998, 1999, 2000]")
def exact_year_frame(spark, sf):
    """FLT19"""
    return S.exact_frame(annual(spark, sf), "entity", 1995, 2000)


@query("fiscal_year_end", "SELECT o_custkey, strftime(max(o_orderdate), '%m-%d') AS fye, make_date(max(year(o_orderdate))::INTEGER, 1, 1) AS as_of FROM orders GROUP BY 1")
def fiscal_year_end(spark, sf):
    """DAT2 DAT3 DAT4"""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "MM-dd").alias("fye"), F.make_date(F.max(F.year("o_orderdate")), F.lit(1), F.lit(1)).alias("as_of"))


#: A small chart of accounts.
FORMULAS = {"margin": 'vals("ebitda") / vals("revenue")', "leverage": 'vals("net_debt") / vals("margin")', "net_debt": 'vals("debt") - default(vals("cash"), 0)'}


@query(
    "formula_availability",
    f"""
    WITH h AS (SELECT entity, year, bool_or(mnemonic = 'ebitda') AS e, bool_or(mnemonic = 'revenue') AS r, bool_or(mnemonic = 'debt') AS d FROM ({_latest}) GROUP BY 1, 2), a AS (SELECT entity, year, (e AND r AND d)::INTEGER AS available FROM h)
    SELECT c.c_nationkey, a.year, sum(available)::BIGINT AS available, count(*) AS n FROM a JOIN customer c ON c.c_custkey = a.entity GROUP BY 1, 2
    """,
)
def formula_availability(spark, sf):
    """COA1-3 AGG10 AGG11: by country and year how many entities a ratio can be made for."""
    a = FM.availability(latest(spark, sf), FORMULAS, "leverage", ["entity", "year"], "mnemonic")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    return a.join(c, "entity").groupBy("c_nationkey", "year").agg(F.sum("available").cast("long").alias("available"), F.count("*").alias("n"))


@query(
    "formula_tree",
    f"""
    WITH t(node, depth) AS (VALUES ('net_debt', 1::BIGINT), ('margin', 1::BIGINT), ('debt', 2::BIGINT), ('cash', 2::BIGINT), ('ebitda', 2::BIGINT), ('revenue', 2::BIGINT)), n AS (SELECT mnemonic AS node, count(*) AS n, count(DISTINCT entity) AS entities FROM ({_latest}) GROUP BY 1)
    SELECT node, depth, coalesce(n, 0)::BIGINT AS n, coalesce(entities, 0)::BIGINT AS entities FROM t LEFT JOIN n USING (node)
    """,
)
def formula_tree(spark, sf):
    """COA1 COA2: inputs below a formula, by a recursive query, with the facts that there are
    for each and the entities that have one."""
    tree = spark.createDataFrame([(p, c) for p, c, _ in FM.edges(FORMULAS)], "parent string, child string")
    n = latest(spark, sf).groupBy(F.col("mnemonic").alias("node"), "entity").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("entities"))
    return FM.reachable(spark, tree, "leverage").join(n, "node", "left").na.fill(0, ["n", "entities"])
