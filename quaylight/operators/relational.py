"""Relational operators: row ids, restatements, as-of joins, spines, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def gapless_ids(df: DataFrame, key: str, name: str = "row_id", offset: int = 0, parts: int = 64) -> DataFrame:
    """PRJ7, PRJ9, WIN2, AGG23: 0-based row number in the order of a numeric key,
    plus an offset, without dealing all rows to one task: rows are numbered within
    at most ``parts`` ranges between approximate quantiles, and ranges are summed.
    Null keys come last; repeated keys get numbers in any order."""
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(sum(((F.col(key) > c).cast("int") for c in cuts), F.lit(0)))
    dealt = df.withColumn("_part", part)
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    # One row a range.
    starts = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last()))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_own") - 1 + offset).cast("long")).drop("_part", "_own", "_start")


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """AGG4, WIN1, WIN9: the first row of each group in a total order."""
    at = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", at).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """WIN3, SRT1, SRT6: ranks 1..k within groups; Spark prunes per task first."""
    return df.withColumn(name, F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG2: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def without_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """FLT10: rows whose key occurs once."""
    return df.join(repeated_keys(df, keys), keys, "left_anti")


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """JN5, SET5: rows with a partner, never multiplied."""
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """SET5: rows without a partner."""
    return df.join(other, on, "left_anti")


def prune_to_years(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """FLT5: years first to last inclusive, as a range that parquet can prune."""
    return df.where((F.col(column) >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col(column) < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def nearest_year(base: DataFrame, peer: DataFrame, keys: list[str], floor_year: int) -> DataFrame:
    """JN22: for each row of ``base`` (keys, year, val) the row of ``peer`` (keys,
    peer, year, val) whose year is closest, the earlier of two as close; values must
    be present and not 0, years not below the floor."""
    ok = lambda d: d.where(F.col("val").isNotNull() & (F.col("val") != 0) & (F.col("year") >= floor_year))
    b = ok(base).withColumnsRenamed({"year": "base_year", "val": "base_val"})
    p = ok(peer).withColumnsRenamed({"year": "peer_year", "val": "peer_val"})
    both = b.join(p, keys)
    rest = [c for c in b.columns + p.columns if c not in keys and c not in ("peer_year", "peer_val")]
    return first_by(both, [*keys, *rest], [F.abs(F.col("base_year") - F.col("peer_year")), F.col("peer_year")])


def last_reported(facts: DataFrame, keys: list[str], floor_year: int) -> DataFrame:
    """JN23: each series' last year whose value is present and not 0."""
    ok = facts.where(F.col("val").isNotNull() & (F.col("val") != 0) & (F.col("year") >= floor_year))
    return ok.groupBy(*keys).agg(F.max("year").alias("year"), F.max_by("val", "year").alias("val"))


def complete(df: DataFrame, rows: DataFrame, columns: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """SET7, JN24, AGG21: every row key with every column key that it meets on
    their common keys, missing values filled. One side must be few rows a key."""
    common = [c for c in rows.columns if c in columns.columns]
    return rows.join(columns, common).join(df, on, "left").na.fill(fill)


def merge_by_type(df: DataFrame, key: str, sep: str = ", ") -> DataFrame:
    """AGG9: one row a key: strings joined in order, doubles averaged, integers
    averaged and cut, other columns the least."""
    out = []
    for c, t in df.dtypes:
        if c == key:
            continue
        if t == "string":
            out.append(F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c))
        elif t in ("double", "float"):
            out.append(F.avg(c).alias(c))
        elif t in ("int", "bigint", "smallint"):
            out.append(F.avg(c).cast(t).alias(c))
        else:
            out.append(F.min(c).alias(c))
    return df.groupBy(key).agg(*out)


def blocked_pairs(queries: DataFrame, rows: DataFrame, by: str, of: str, each: int = 4096) -> DataFrame:
    """A stated query set against all rows. Up to ``each`` queries are sent to the rows,
    which are neither copied nor shuffled; more are cut into blocks of that size, and a
    task has one block and one part of the rows: there are as many parts as leave every
    shuffle partition a pair of them, however many rows there are."""
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // each))
    if blocks == 1:
        one = F.lit(0).alias("_block")
        return rows.select("*", one).join(F.broadcast(queries.select("*", one)), "_block").drop("_block")
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    q = queries.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = rows.withColumn("_part", F.pmod(F.xxhash64(of, F.lit(3)), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return q.join(r, ["_block", "_part"]).drop("_block", "_part")
