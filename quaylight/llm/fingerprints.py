"""Document fingerprints: SimHash over weighted terms, with DataFrame functions only.

A term is a pair of neighbouring words, weighted by the length of its first word
(long words are rarer) and by its repeats. Each term's 64-bit hash votes with its
weight for its set bits and against the others; the sign of the sum is the bit.
Two bits' sums share a 64-bit counter, so a document takes 33 sums; all are made
by partial aggregation, without lists of terms.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import SPACE, stored, table

BITS = 64


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` of the texts of ``rows``; rows with equal keys count as
    one text. Rows whose text has no word are left out: their fingerprint is 0.

    A sum of weights can't exceed the characters of a text, so 32 bits hold it for
    any string there can be.
    """
    w = F.array_remove(F.split(text, SPACE), "")
    pairs = rows.select(*keys, w.alias("_w")).select(*keys, F.inline(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))).alias("_a", "_b"))
    votes = pairs.select(*keys, F.xxhash64("_a", "_b").alias("_h"), F.char_length("_a").cast("long").alias("_n"))
    two = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(two) * F.col("_n")).alias(f"_s{k}") for k in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("_n").alias("_all"), *sums)

    def bit(k: int) -> Column:
        own = F.shiftrightunsigned(f"_s{k - 32}", 32) if k >= 32 else F.col(f"_s{k}").bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(own * 2 > F.col("_all"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(BITS))).alias("fp"))


def distance(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the bits that agree."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def block_tables(radius: int, agree: int = 1) -> list[list[tuple[int, int]]]:
    """Permuted tables: of radius + agree blocks, each choice of ``agree`` blocks
    leads in one table, and two fingerprints in the radius meet in at least one."""
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], agree)]


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, agree: int = 2) -> DataFrame:
    """(query, id, distance) of every fingerprint of ``fps`` (id, fp) in the radius
    of one of ``queries`` (query, fp), each pair once.

    Both sides are dealt to the block tables and joined on the leading bits; more
    ``agree`` makes more tables with longer keys, for more rows. Equal fingerprints
    are joined as one and spread out last, so copies don't multiply candidates.
    Null fingerprints match nothing.
    """
    tables = block_tables(radius, agree)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("no"), F.xxhash64(*(F.shiftrightunsigned(name, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in blocks)).alias("lead")) for i, blocks in enumerate(tables)]
        return df.where(F.col(name).isNotNull()).select(name).distinct().select(name, F.explode(F.array(*keys)).alias("k")).select(name, "k.no", "k.lead")

    q, f = dealt(queries.select(F.col("fp").alias("qf")), "qf"), dealt(fps.select("fp"), "fp")
    pairs = q.join(f, ["no", "lead"]).where(distance("qf", "fp") <= radius).select("qf", "fp").distinct()
    return queries.select("query", F.col("fp").alias("qf")).join(pairs, "qf").join(fps.select("id", "fp"), "fp").select("query", "id", distance("qf", "fp").cast("int").alias("distance"))


def class_links(docs: DataFrame, queries: Column, radius: int = 3, agree: int = 2) -> DataFrame:
    """(query_class, class, n_queries, n_rows, distance) for each two fingerprints in the
    radius of which the first is of a row that ``queries`` admits: a class is the rows of
    ``docs`` (doc_id, text) with one fingerprint, named by its smallest doc_id (null only
    where it has no other); n_queries and n_rows are the rows of either side. Copies are
    not expanded into pairs. Texts without words have fingerprint 0, null ids are not
    queries, an empty table gives no rows."""
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Equal texts have equal fingerprints, so each different text is fingerprinted once.
    texts = numbered.select(F.md5("text").alias("m"), "text", "doc_id", queries.alias("asked"))
    own = texts.groupBy("m").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.count_if("asked").alias("asked"))
    fps = fingerprints(texts.select("m", "text").dropDuplicates(["m"]), ["m"])
    known = own.join(fps, "m", "left").na.fill(0, ["fp"])
    classes = stored(known.groupBy("fp").agg(F.min("least").alias("id"), F.sum("rows").alias("n_rows"), F.sum("asked").alias("n_queries")), "classes")
    asked = classes.where("n_queries > 0")
    found = within(asked.select(F.col("fp").alias("query"), "fp"), classes.select(F.col("fp").alias("id"), "fp"), radius, agree)
    left = asked.select(F.col("fp").alias("query"), F.col("id").alias("query_class"), "n_queries")
    right = classes.select("fp", F.col("id").alias("class"), "n_rows")
    return found.withColumnRenamed("id", "fp").join(left, "query").join(right, "fp").select("query_class", "class", "n_queries", "n_rows", "distance")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints within three bits of those of the rows whose id 20 divides."""
    return class_links(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def with_neighbours(narrow: DataFrame, parts: int) -> DataFrame:
    """Adds next_* and prev_* (kid, h, n) in the order of kid descending, h; the
    last row's next is the first. Rows are dealt by range and chained there, and
    the ends of at most ``parts`` ranges are chained among themselves."""
    order = [F.col("kid").desc(), F.col("h")]
    ranged = stored(narrow.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "order")
    this = F.struct("kid", "h", "n")
    own = W.Window.partitionBy("pid").orderBy(*order)
    chained = ranged.withColumn("next", F.lead(this).over(own)).withColumn("prev", F.lag(this).over(own))
    key = F.struct(F.bitwise_not("kid").alias("k"), "h")
    ends = ranged.groupBy("pid").agg(F.min_by(this, key).alias("a"), F.max_by(this, key).alias("z"))
    by, all_ = W.Window.orderBy("pid"), W.Window.orderBy("pid").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    ends = ends.select("pid", F.coalesce(F.lead("a").over(by), F.first("a").over(all_)).alias("after"), F.coalesce(F.lag("z").over(by), F.last("z").over(all_)).alias("before"))
    return chained.join(F.broadcast(ends), "pid").select("kid", "h", "n", "m", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the fingerprint of the text,
    of the text with its last third replaced by the start of the next document's,
    and how alike they are.

    The next document is the one with the next lower doc_id (null ids come last,
    rows of one id by a hash of the text), after the last the first. Rows repeated
    whole follow one another. Null texts are empty; fingerprints of texts without
    words are 0; a single row is its own next. The texts are shuffled once by id,
    and the borrowed starts once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    # Both uses of the texts read the same columns, so that one shuffle serves them.
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("kid"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    narrow = rows.groupBy("kid", "h").agg(F.count("*").alias("m"), F.first(F.char_length("text")).cast("long").alias("n"))
    links = stored(with_neighbours(narrow, parts), "links")
    links = links.select("kid", "h", "m", "n", F.col("next.kid").alias("next_kid"), F.col("next.h").alias("next_h"), F.col("prev.kid").alias("prev_kid"), F.col("prev.h").alias("prev_h"), F.floor(F.col("prev.n") / 3).cast("int").alias("lends"))
    both = rows.join(links, ["kid", "h"])
    at = F.row_number().over(W.Window.partitionBy("kid", "h").orderBy(F.lit(1)))
    own = both.withColumn("idx", at)
    heads = own.where("idx = 1").select(F.col("prev_kid").alias("kid"), F.col("prev_h").alias("h"), F.substring("text", F.lit(1), F.col("lends")).alias("head"))
    cut = F.floor(F.col("n") / 3).cast("int")
    last = F.col("idx") == F.col("m")
    head = F.when(last, F.coalesce("head", F.lit(""))).otherwise(F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - cut).cast("int")), F.substring(head, F.lit(1), cut))
    whole = own.join(heads, ["kid", "h"], "left").withColumn("edited", edited)
    keys = ["kid", "h", "idx"]
    variants = whole.select(*keys, F.posexplode(F.array("text", "edited")).alias("variant", "text"))
    fps = fingerprints(variants, [*keys, "variant"])
    two = fps.groupBy(*keys).agg(F.max(F.when(F.col("variant") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("variant") == 1, F.col("fp"))).alias("edited_fp"))
    meta = whole.select(*keys, "m", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.when(last, F.col("next_kid")).otherwise(F.col("kid")).alias("next_kid"), F.when(last, F.col("next_h")).otherwise(F.col("h")).alias("next_h"))
    found = stored(meta.join(two, keys, "left").na.fill(0, ["fp", "edited_fp"]), "fingerprints")
    of_next = found.where("idx = 1").select(F.col("kid").alias("next_kid"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    out = found.join(of_next, ["next_kid", "next_h"])
    doc_id = F.when(F.col("kid") > -(2**63), F.col("kid")).alias("doc_id")
    return out.select(doc_id, F.col("n").alias("n_chars"), "edited_sha256", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_likeness(table(spark, sf_dir, "documents"))
    hex16 = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
