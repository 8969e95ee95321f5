"""Mixing sources to target weights, with DataFrame functions only.

Targets come from source weights by water-filling; complete epochs are taken
first, the rest of a target by Efraimidis-Spirakis sampling: each document draws
an exponential key scaled by its quality weight, and documents are taken in key
order while the running sum of words stays nearest the budget.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import forget, n_words, packed, small, stored, table, unpacked

#: What is made of the measure of a row.
Measured = Callable[[Column], Column]
#: Ranges of the sampling key for each doubling of it. Whatever the qualities, no
#: range is expected to hold over ln 2 / e / STEPS, 0.05 %, of a source's rows.
STEPS = 512


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target``. Weights go to sources by code point, null last, repeating.
    The targets are least(most * size, level * weight) with the level at which
    they sum to ``share`` of all sizes: what remains when sources that reach their
    limit pass the excess on by weight until none is above. One row a source is
    sorted in one task."""
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    every = W.Window.partitionBy()
    s = sources.withColumn("i", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("w"))
    s = s.withColumn("budget", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("limit").over(every)))
    full = W.Window.orderBy("level", "i").rowsBetween(W.Window.unboundedPreceding, -1)
    rest = W.Window.orderBy("level", "i").rowsBetween(0, W.Window.unboundedFollowing)
    s = s.withColumn("own_level", (F.col("budget") - F.coalesce(F.sum("limit").over(full), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source, by level, that the common level doesn't fill sets it.
    s = s.withColumn("common", F.min(F.when(F.col("own_level") < F.col("level"), F.struct(F.col("level").alias("a"), F.col("own_level").alias("b")))).over(every)["b"])
    return s.withColumn("target", F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("w"))))


def unit(*cols: str | Column) -> Column:
    """A reproducible number in (0, 1) from columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2**53))


def text_counts(text: str | Column) -> Column:
    """Words, characters, lines and full stops of a text; 0 for null. The last two are
    bytes taken out, which is cheaper than patterns."""
    text = F.coalesce(text, F.lit(""))
    count = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return F.struct(n_words(text).alias("words"), F.char_length(text).alias("chars"), (count("\n") + 1).alias("lines"), count(".").alias("stops"))


def prose_weight(m: Column) -> Column:
    """A weight from 0.05 to 1 of how much a text of ``text_counts`` looks like prose,
    halved for each of: under 20 words, a mean word length outside 2 to 12, under 4 words
    a line, and under 3 or over 80 words a full stop. Null and empty texts have 0.05.
    Labels take no part."""
    half = lambda ok: F.when(ok, 1.0).otherwise(0.5)
    usual = half(m["words"] >= 20) * half(((m["chars"] - m["words"]) / m["words"]).between(2, 12)) * half(m["words"] >= 4 * m["lines"])
    usual *= half((m["words"] >= 3 * m["stops"]) & (m["words"] <= 80 * (m["stops"] + 1)))
    return F.when(m["words"] == 0, F.lit(0.05)).otherwise(usual)


def key_range(key: str | Column) -> Column:
    """Number of the range of a positive key: equal steps of its logarithm."""
    return F.floor(F.log2(key) * STEPS).cast("int")


def mix(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, measure: Column, size: Measured, quality: Measured, seed: int = 1) -> DataFrame:
    """``_row``, ``_size``, ``_source_size``, ``_target`` and ``_copies`` of every row of
    ``rows`` (doc_id, source and any others): its columns in one struct, and how often
    the mix takes the row. ``measure`` is an expression over its columns that is worked
    out once a row, ``size`` and ``quality`` are made of it.

    A source with target T and size S takes every row floor(T / S) times, then the
    rows with the least keys -ln(u) / quality, one by one, for the remainder: a row
    is taken if that leaves the sum nearer the remainder than without it. Such rows
    come before all others of their source, so one bound for each source decides: the
    sums of key ranges find the range that holds it, and only that range is put in
    order. u is a hash of doc_id and the seed, so reruns agree.

    Null sizes are 0 and null, small or non-positive qualities 1e-6; rows of size 0
    are taken with the complete epochs only; a null source is a source; a null doc_id
    is replaced by a hash of all columns, ties are ordered by that hash, and of rows
    repeated whole the bound may take some; an empty table gives no rows; columns of
    any name pass through.
    """
    n = F.greatest(F.coalesce(size(F.col("_m")), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    q = F.greatest(F.coalesce(quality(F.col("_m")).cast("double"), F.lit(1e-6)), F.lit(1e-6))
    source = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("_source")
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t))
    wide = rows.select(packed(rows.columns), source, measure.alias("_m"), F.col("doc_id").alias("_id"), tie.alias("_tie"))
    wide = wide.select("_row", "_source", n.alias("_size"), q.alias("_q"), "_id", "_tie")
    u = unit("_id", F.when(F.col("_id").isNull(), F.col("_tie")), F.lit(seed))
    wide = wide.withColumn("_key", -F.log(u) / F.col("_q")).drop("_q", "_id").withColumn("_range", key_range("_key"))
    keyed = stored(wide.select("_source", "_size", "_key", "_tie", "_range"), "keys")
    sums = stored(keyed.groupBy("_source", "_range").agg(F.sum("_size").alias("n")), "ranges")
    sources = _targets(sums.groupBy("_source").agg(F.sum("n").alias("source_size")).withColumn("source", F.when(~F.col("_source.n"), F.col("_source.s"))), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("_epochs", epochs).select("_source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs", (F.col("target") - F.col("_epochs") * F.col("source_size")).alias("_left"))
    before = W.Window.partitionBy("_source").orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # The last range that begins before the budget ends.
    last = starts.join(sources, "_source").where(F.col("_start") <= F.col("_left")).groupBy("_source").agg(F.max(F.struct("_range", "_start")).alias("x"))
    sources = stored(sources.join(last, "_source", "left").select("*", "x._range", "x._start").drop("x").withColumnRenamed("_range", "_last"), "sources")
    own = W.Window.partitionBy("_source").orderBy("_key", "_size", "_tie")
    at = F.col("_start") + F.coalesce(F.sum("_size").over(own.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    there = keyed.where("_size > 0").join(small(sources.select("_source", F.col("_last").alias("_range"), "_start", "_left")), ["_source", "_range"])
    there = there.withColumn("_at", at)
    # Nearer with the row than without it: half of it at least fits.
    fits = F.col("_at") + F.col("_size") / 2 <= F.col("_left")
    mine = F.struct("_key", "_size", "_tie")
    bound = there.where(fits).groupBy("_source").agg(F.max(mine).alias("_bound"))
    equal = there.join(bound, "_source").where(mine == F.col("_bound")).groupBy("_source").agg(F.count_if(fits).alias("_equal"), F.count("*").alias("_all"))
    bounds = stored(sources.join(bound, "_source", "left").join(equal, "_source", "left"), "bounds")
    forget(keyed, sums, sources)
    judged = wide.join(small(bounds), "_source")
    at_bound = F.coalesce((F.col("_range") == F.col("_last")) & (mine == F.col("_bound")), F.lit(False))
    within = (F.col("_size") > 0) & (F.coalesce(F.col("_range") < F.col("_last"), F.lit(False)) | F.coalesce((F.col("_range") == F.col("_last")) & (mine <= F.col("_bound")), F.lit(False)))

    def taken(df: DataFrame, again: Column) -> DataFrame:
        return df.select("_row", "_size", "_source_size", "_target", (F.col("_epochs") + again.cast("int")).alias("_copies"))

    if not bounds.where("_equal < _all").count():
        return taken(judged, within)
    # Rows repeated whole at a bound that takes some of them.
    nth = F.row_number().over(W.Window.partitionBy("_source").orderBy("_key"))
    edge = judged.where(at_bound).withColumn("_nth", nth)
    return taken(judged.where(~at_bound), within).unionByName(taken(edge, F.col("_nth") <= F.col("_equal")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, measure=text_counts("text"), size=lambda m: m["words"], quality=prose_weight)
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
