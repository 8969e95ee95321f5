"""Pair features, linear ranking, ranking metrics and annotator agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import numbers as N
from .scan import scanned

#: Widths of the log windows.
WINDOWS = tuple(round(0.2 * i, 1) for i in range(1, 11))


def window_features(df: DataFrame, base: str, peer: str, base_year: str, peer_year: str, name: str, widths: tuple[float, ...] = WINDOWS) -> DataFrame:
    """RNK2, RNK3: an indicator for each width, 0 and ``no_<name>`` = 1 where a value is
    missing or the years are over two apart."""
    near = F.coalesce(F.abs(F.col(base_year) - F.col(peer_year)) <= 2, F.lit(False)) & F.col(base).isNotNull() & F.col(peer).isNotNull()
    flags = {f"{name}_{w:.2f}".replace(".", "_"): F.when(near, N.log_window(F.col(peer), F.col(base), w)).otherwise(0.0) for w in widths}
    return df.withColumns(flags | {f"no_{name}": (~near).cast("double")})


def linear_score(weights: dict[str, float]) -> Column:
    """RNK5: weighted sum of features, without bias; null features are 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


def closeness(rev: Column, ebitda: Column, rev0: Column, ebitda0: Column) -> Column:
    """RNK10: product of symmetric ratios of revenue and margin."""
    return N.symmetric_ratio(rev, rev0) * N.symmetric_ratio(N.ratio(ebitda, rev), N.ratio(ebitda0, rev0))


def running_precision(df: DataFrame, keys: list[str], rel: str, order: list[Column]) -> DataFrame:
    """MET1, WIN5, WIN6: adds position (1-based), hits so far and precision there. Orders
    here and below are ascending."""
    hit = F.when(F.col(rel) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return scanned(df, keys, order, "pos", {"hits": hit}).withColumn("precision", F.col("hits") / F.col("pos"))


def average_precision(df: DataFrame, keys: list[str], rel: str, order: list[Column]) -> DataFrame:
    """MET2: mean precision at the relevant rows of each list; 0 without any."""
    p = running_precision(df, keys, rel, order)
    return p.groupBy(*keys).agg(F.round(F.coalesce(F.avg(F.when(F.col(rel) > 0, F.col("precision"))), F.lit(0.0)), 6).alias("ap"))


def ndcg(df: DataFrame, keys: list[str], rel: str, order: list[Column], tie: str) -> DataFrame:
    """MET3, WIN7: gain 2^rel - 1 by log2(position + 1), over the ideal order's; null
    where that is 0."""
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    d = scanned(scanned(df, keys, order, "_p"), keys, [-F.col(rel), F.col(tie)], "_i")
    return d.groupBy(*keys).agg(F.round(F.try_divide(F.sum(gain / F.log2(F.col("_p") + 1)), F.sum(gain / F.log2(F.col("_i") + 1))), 6).alias("ndcg"))


def preferences(df: DataFrame, keys: list[str], item: str, rel: str) -> DataFrame:
    """JN15: pairs of a list whose first is more relevant. The join is by list and
    levels of relevance, so it makes no row that isn't a preference."""
    levels = df.select(*keys, rel).distinct()
    lower = levels.join(levels.withColumnRenamed(rel, "_hi"), keys).where(F.col("_hi") > F.col(rel))
    a = df.select(*keys, F.col(item).alias("better"), F.col(rel).alias("_hi"))
    return a.join(lower, [*keys, "_hi"]).join(df.select(*keys, F.col(item).alias("worse"), rel), [*keys, rel]).select(*keys, "better", "worse", F.col("_hi").alias("rel_better"), F.col(rel).alias("rel_worse"))


def preference_counts(df: DataFrame, keys: list[str], rel: str) -> DataFrame:
    """ANN3: number of preferences of a list from its counts by relevance."""
    n = df.groupBy(*keys, rel).agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(W.Window.partitionBy(*keys).orderBy(rel).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("b", below).groupBy(*keys).agg(F.sum(F.col("n") * F.col("b")).alias("n_pairs"))


def inversion_counts(df: DataFrame, keys: list[str], rel: str, order: list[Column]) -> DataFrame:
    """JN16, JN17, RNK11: of each list the concordant and discordant pairs of
    relevance and position, and Kendall's tau-b without ties in position. Counted by
    running sums over positions for each level, not by making the pairs."""
    levels = df.select(*keys, F.col(rel).alias("level")).distinct()
    same = (F.col(rel) == F.col("level")).cast("long")
    seen = scanned(df.join(levels, keys), [*keys, "level"], order, "_p", {"before": same}).withColumn("before", F.col("before") - same)
    pairs = seen.groupBy(*keys).agg(F.sum(F.when(F.col("level") > F.col(rel), F.col("before")).otherwise(0)).alias("concordant"), F.sum(F.when(F.col("level") < F.col(rel), F.col("before")).otherwise(0)).alias("discordant"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    c, d, all_ = F.col("concordant"), F.col("discordant"), F.col("n") * (F.col("n") - 1) / 2
    return pairs.join(n, keys).select(*keys, "concordant", "discordant", F.round(F.try_divide((c - d).cast("double"), F.sqrt((c + d) * all_)), 6).alias("tau"))


def agreement(df: DataFrame, task: str, item: str, analyst: str, label: str) -> DataFrame:
    """ANN2, ANN3, JN20: of each task how many pairs of analysts agree on items; from
    counts of labels by item, since c analysts with one label make c(c-1)/2 pairs."""
    n = df.groupBy(task, item, label).agg(F.count("*").alias("c"))
    by = n.groupBy(task, item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.max("c").alias("top"))
    return by.groupBy(task).agg((F.sum("same") / 2).cast("long").alias("agreeing"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("pairs"), F.sum((F.col("top") * 2 > F.col("n")).cast("long")).alias("majority"), F.sum((F.col("top") * 2 == F.col("n")).cast("long")).alias("stalemate"))


def krippendorff(df: DataFrame, item: str, label: str) -> DataFrame:
    """ANN5: alpha with the ordinal distance, from the coincidences of label values;
    items with one judgement are left out. One row; null without expected disagreement."""
    n = df.groupBy(item, label).agg(F.count("*").cast("double").alias("c"))
    m = n.groupBy(item).agg(F.sum("c").alias("m")).where("m > 1")
    n = n.join(m, item)
    left, right = n.select(item, "m", F.col(label).alias("a"), F.col("c").alias("ca")), n.select(item, F.col(label).alias("b"), F.col("c").alias("cb"))
    # Values are few, whatever the number of items.
    o = left.join(right, item).withColumn("o", F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1)).otherwise(F.col("ca") * F.col("cb")) / (F.col("m") - 1)).groupBy("a", "b").agg(F.sum("o").alias("o"))
    marg = o.groupBy(F.col("a").alias("v")).agg(F.sum("o").alias("n"))
    cum = marg.withColumn("cum", F.sum("n").over(W.Window.orderBy("v").rowsBetween(W.Window.unboundedPreceding, 0)))
    one, two = cum.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("cum").alias("cua")), cum.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("cum").alias("cub"))
    grid = one.join(two, F.col("a") < F.col("b")).join(o, ["a", "b"], "left")
    delta = F.pow(F.col("cub") - F.col("cua") + F.col("na") / 2 - F.col("nb") / 2, F.lit(2.0))
    total = marg.agg(F.sum("n").alias("total"))
    s = grid.agg(F.sum(F.coalesce("o", F.lit(0.0)) * delta).alias("do"), F.sum(F.col("na") * F.col("nb") * delta).alias("de"))
    return s.join(F.broadcast(total)).select(F.round(1 - (F.col("total") - 1) * F.try_divide("do", "de"), 6).alias("alpha"))


def rank_buckets(df: DataFrame, rank: str) -> DataFrame:
    """MET5-7: how many ranks are in the top 10, 20, 50, 100, beyond or absent (-1),
    and the mean reciprocal rank of hits to 20, and of all with 0 for none."""
    r = F.col(rank)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.agg(
        *(count((r >= 1) & (r <= k)).alias(f"top_{k}") for k in (10, 20, 50, 100)), count(r > 100).alias("beyond"), count(r == -1).alias("absent"),
        F.round(F.avg(F.when(r.between(1, 20), 1.0 / r)), 6).alias("mrr_hits"), F.round(F.avg(F.when(r >= 1, 1.0 / r).otherwise(0.0)), 6).alias("mrr"),
    )
