"""Deterministic sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import arithmetic_hash
from .scan import scanned


def split_name(key: Column, shares: dict[str, int], seed: int = 0) -> Column:
    """SMP6, SMP7, SNK7: split of a key by its hash; shares are percent."""
    at, out, low = arithmetic_hash(key, seed) % 100, None, 0
    for name, share in shares.items():
        low += share
        out = F.when(at < low, name) if out is None else out.when(at < low, name)
    return out


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """SMP1: Bernoulli rows of each stratum with fraction least(1, n / size), by the
    key's hash; strata are counted first, and joined as one row each."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    return df.join(size, stratum).where(arithmetic_hash(F.col(key), seed) < F.least(F.lit(1.0), F.lit(float(n)) / F.col("_n")) * 4294967296.0).drop("_n")


def quota(df: DataFrame, sector: str, strata: list[str], key: str, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """SMP2: of each sector its quota, an equal ceiling share from each stratum, then
    topped up from the rest; sectors with too few rows give none. Rows are ranked by
    the key's hash, so reruns agree."""
    h = arithmetic_hash(F.col(key), seed)
    sized = df.join(quotas, sector)
    n = df.groupBy(sector).agg(F.count("*").alias("_have"), F.count_distinct(F.struct(*strata)).alias("_strata"))
    sized = sized.join(n, sector).where(F.col("_have") >= F.col("quota"))
    ranked = scanned(sized.withColumn("_h", h), [sector, *strata], [F.col("_h"), F.col(key)], "_in")
    late = F.col("_in") > F.ceil(F.col("quota") / F.col("_strata"))
    at = scanned(ranked.withColumn("_late", late), [sector], [F.col("_late"), F.col("_h"), F.col(key)], "_at")
    return at.where(F.col("_at") <= F.col("quota")).drop("_have", "_strata", "_h", "_in", "_late", "_at", "quota")


def negatives(bases: DataFrame, base: str, pool: DataFrame, row_id: str, size: int, k: int, seed: int = 0) -> DataFrame:
    """SMP4, JN8, ARR2: k rows of a pool with gapless ids for each base, with
    replacement, at hashes of (base, draw)."""
    draws = bases.select(base).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    draws = draws.withColumn(row_id, arithmetic_hash(F.col(base) * 131 + F.col("draw"), seed) % size)
    return draws.join(pool, row_id)


def negatives_within(bases: DataFrame, base: str, pool: DataFrame, member: str, group: str, k: int, seed: int = 0) -> DataFrame:
    """JN11, ARR2: as ``negatives``, from the members of the base's group in their order.
    A group of the pool is numbered as a whole: it is a list of ids."""
    own = W.Window.partitionBy(group)
    numbered = pool.select(member, group).withColumn("_i", F.row_number().over(own.orderBy(member)) - 1).withColumn("_n", F.count("*").over(own))
    sizes = numbered.groupBy(group).agg(F.max("_n").alias("_n"))
    draws = bases.select(base, group).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(sizes, group)
    draws = draws.withColumn("_i", arithmetic_hash(F.col(base) * 131 + F.col("draw"), seed) % F.col("_n")).drop("_n")
    return draws.join(numbered.drop("_n"), [group, "_i"]).drop("_i")


def some(df: DataFrame, n: int, seed: int) -> DataFrame:
    """SMP3: n random rows without replacement, all if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def some_of(ids: Column, n: int, seed: int) -> Column:
    """SMP5: n of an array, none if it is shorter."""
    return F.when(F.size(ids) >= n, F.slice(F.shuffle(ids, seed), 1, n)).otherwise(F.slice(ids, 1, 0))
