"""Annual series: growth, alignment, imputation, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def growth(df: DataFrame, keys: list[str], year: str = "year", val: str = "val") -> DataFrame:
    """WIN8: growth on the year before to 3 places, clipped to [-1, 1]; null for the
    first year and after a zero."""
    before = F.lag(val).over(W.Window.partitionBy(*keys).orderBy(year))
    return df.withColumn("growth", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(F.try_divide(F.col(val) - before, before), 3))))


def yoy(df: DataFrame, keys: list[str], year: str = "year", val: str = "val") -> DataFrame:
    """WIN13: change on the year before by the signs of both values (relative to the
    size of the earlier), cubed, through the logistic function."""
    before, now = F.lag(val).over(W.Window.partitionBy(*keys).orderBy(year)), F.col(val)
    rel = F.when((before > 0) & (now > 0), F.try_divide(now - before, before)).when((before < 0) & (now < 0), F.try_divide(before - now, before)).when((before <= 0) & (now >= 0), 1.0).when((before >= 0) & (now <= 0), -1.0)
    return df.withColumn("change", rel).withColumn("squashed", F.round(1 / (1 + F.exp(-F.pow(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), rel)), F.lit(3.0)))), 6))


def level_delta(df: DataFrame, keys: list[str], cap: float, year: str = "year", val: str = "val") -> DataFrame:
    """WIN14: the capped level and the capped change to the next year; null for the last."""
    clip = lambda c: F.greatest(F.lit(-cap), F.least(F.lit(cap), c))
    nxt = F.lead(val).over(W.Window.partitionBy(*keys).orderBy(year))
    return df.withColumn("level", clip(F.col(val))).withColumn("delta", F.when(nxt.isNotNull(), clip(nxt - F.col(val))))


def common_years(df: DataFrame, entity: str, item: str, least_items: int, k: int = 3, which: str = "earliest") -> DataFrame:
    """JN24, WIN10-12: years in which an entity has at least ``least_items`` items;
    of its newest 20 such years the k earliest (or latest)."""
    years = df.groupBy(entity, "year").agg(F.count_distinct(item).alias("items")).where(F.col("items") >= least_items)
    new = F.row_number().over(W.Window.partitionBy(entity).orderBy(F.desc("year")))
    years = years.withColumn("_n", new).where("_n <= 20")
    order = F.asc("year") if which == "earliest" else F.desc("year")
    return years.withColumn("nth", F.row_number().over(W.Window.partitionBy(entity).orderBy(order)).cast("long")).where(F.col("nth") <= k).drop("_n")


def exact_frame(df: DataFrame, entity: str, first: int, last: int) -> DataFrame:
    """FLT19: entities whose years are exactly first..last."""
    years = df.groupBy(entity).agg(F.array_sort(F.collect_set("year")).alias("y"))
    return years.where(F.col("y") == F.array(*(F.lit(i) for i in range(first, last + 1)))).select(entity)


def right_aligned(df: DataFrame, keys: list[str]) -> DataFrame:
    """WIN15: offset of each year from the series' last."""
    return df.withColumn("offset", (F.max("year").over(W.Window.partitionBy(*keys)) - F.col("year")).cast("long"))


def sector_average(df: DataFrame, sector: str, entity: str, first: int, last: int) -> DataFrame:
    """AGG32: sector average by year over a full spine of years; a missing or zero
    value counts as the entity's own average."""
    spine = df.select(sector, entity).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    own = df.where(F.col("val") != 0).groupBy(entity).agg(F.avg("val").alias("own"))
    full = spine.join(df.select(entity, "year", "val"), [entity, "year"], "left").join(own, entity, "left")
    return full.groupBy(sector, "year").agg(F.round(F.avg(F.coalesce(F.when(F.col("val") != 0, F.col("val")), "own")), 4).alias("avg_val"))


def curves(df: DataFrame, sector: str, entity: str, pos: str, val: str, places: int = 6) -> DataFrame:
    """AGG33, FCS1: element-wise mean of the series of a sector, constant ones left out."""
    moving = df.groupBy(entity).agg(F.count_distinct(val).alias("n")).where("n > 1").select(entity)
    return df.join(moving, entity, "left_semi").groupBy(sector, pos).agg(F.round(F.avg(val), places).alias("curve"))


def growth_category(df: DataFrame, entity: str, sector: str, val: str = "growth") -> DataFrame:
    """FCS7: red, blue or green as the mean growth is in the lowest quarter of the
    sector's range, between, or in the highest."""
    mean = df.groupBy(sector, entity).agg(F.avg(val).alias("mean"))
    ends = mean.groupBy(sector).agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    quarter = (F.col("_hi") - F.col("_lo")) / 4
    category = F.when(F.col("mean") <= F.col("_lo") + quarter, "red").when(F.col("mean") >= F.col("_hi") - quarter, "green").otherwise("blue")
    return mean.join(ends, sector).withColumn("category", category).drop("_lo", "_hi")


def forecast_error(actual: Column, forecast: Column) -> Column:
    """FCS8: |a - f| / a; an actual of 0 counts as 0.01."""
    base = F.when(actual == 0, 0.01).otherwise(actual)
    return F.abs(base - forecast) / F.abs(base)


def min_max(c: str, low: float, high: float, keys: list[str] | None = None) -> Column:
    """AGG37: scaled to [low, high] over all rows (or groups); low for a constant.
    Without keys the extremes are of the whole table: use ``min_max_table``."""
    w = W.Window.partitionBy(*(keys or []))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0)) * (high - low) + low


def min_max_table(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """AGG37 over a whole table: the extremes are one row sent to every task."""
    ends = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * (high - low) + low
    return df.join(F.broadcast(ends)).withColumn("scaled", F.round(scaled, 6)).drop("_lo", "_hi")
