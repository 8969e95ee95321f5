"""A multinomial text classifier made of counts and joins, and its best labels by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes up to which what a term adds to each is a column.
WIDE = 64


def class_counts(terms: DataFrame, label: str, term: str = "term", n: str = "tf") -> DataFrame:
    """(label, term, n): occurrences by class."""
    return terms.groupBy(label, term).agg(F.sum(n).alias("n"))


def classes(docs: DataFrame, counts: DataFrame, label: str) -> DataFrame:
    """(label, docs, words) of each class; one row a class."""
    return docs.groupBy(label).agg(F.count("*").alias("docs")).join(counts.groupBy(label).agg(F.sum("n").alias("words")), label, "left").na.fill({"words": 0})


def posteriors(docs: DataFrame, terms: DataFrame, counts: DataFrame, of: DataFrame, doc: str, label: str) -> DataFrame:
    """(doc, label, p): the chance of each class given a document's terms, with one added to
    each count. ``docs`` has the documents, ``terms`` their (doc, term, tf).

    What a term that a class doesn't have counts there depends on the class only, so it is
    taken from the document's length, and documents meet only classes that have their terms.
    The rest is per document: a sum for each class and the logarithm of the sum of
    exponentials, from one row that has all classes. Documents without terms have the
    prior; terms that no class has count alike for all."""
    kinds = counts.agg(F.count_distinct("term").alias("kinds"))
    weighed = of.join(F.broadcast(kinds)).join(F.broadcast(of.agg(F.sum("docs").alias("all"))))
    # one row: classes are few beside documents and terms
    listed = weighed.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.log(F.col("docs") / F.col("all")).alias("prior"), F.log(F.col("words") + F.col("kinds")).alias("base")))).alias("_classes"))
    named = sorted(r[0] for r in of.select(label).where(F.col(label).isNotNull()).limit(WIDE + 1).collect())
    if len(named) <= WIDE:
        # a row a term with what each class adds, so that a posting meets one row and a document has one sum a class
        each = [F.coalesce(F.max(F.when(F.col(label) == c, F.log(F.col("n") + 1.0))), F.lit(0.0)).alias(f"_w{i}") for i, c in enumerate(named)]
        shared = terms.join(counts.groupBy("term").agg(*each), "term", "left")
        sums = [F.coalesce(F.sum(F.col("tf") * F.col(f"_w{i}")), F.lit(0.0)) for i in range(len(named))]
        by_doc = shared.groupBy(doc).agg(F.map_from_arrays(F.array(*map(F.lit, named)).cast(f"array<{of.schema[label].dataType.simpleString()}>"), F.array(*sums).cast("array<double>")).alias("_sums"), F.sum("tf").alias("_length"))
        d = docs.select(doc).join(by_doc, doc, "left").join(F.broadcast(listed))
    else:
        shared = terms.join(counts.select("term", F.col(label).alias("_label"), F.log(F.col("n") + 1.0).alias("w")), "term")
        sums = shared.groupBy(doc, "_label").agg(F.sum(F.col("tf") * F.col("w")).alias("s"))
        by_doc = sums.where("_label IS NOT NULL").groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("_label", "s"))).alias("_sums"))
        length = terms.groupBy(doc).agg(F.sum("tf").alias("_length"))
        d = docs.select(doc).join(by_doc, doc, "left").join(length, doc, "left").join(F.broadcast(listed))
    own = lambda c: F.coalesce(F.col("_sums")[c["label"]], F.lit(0.0))
    score = F.transform("_classes", lambda c: c["prior"] + own(c) - F.coalesce(F.col("_length"), F.lit(0)) * c["base"])
    d = d.withColumn("_score", score)
    d = d.withColumn("_top", F.array_max("_score"))
    d = d.withColumn("_all", F.aggregate("_score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("_top"))))
    p = F.explode(F.zip_with("_classes", "_score", lambda c, s: F.struct(c["label"].alias("label"), (F.exp(s - F.col("_top")) / F.col("_all")).alias("p")))).alias("_e")
    return d.select(doc, p).select(doc, F.col("_e.label").alias(label), F.col("_e.p").alias("p"))


def best_labels(found: DataFrame, doc: str, label: str, names: DataFrame, k: int = 3, above: float = 0.1) -> DataFrame:
    """TXT29: (doc, name, p, rank) of the ``k`` likeliest classes of each document that are
    likelier than ``above``; ``names`` has (label, name), and a code without one is its own name."""
    from .relational import top_k

    best = top_k(found.where(F.col("p") > above), [doc], [F.desc("p"), F.asc(label)], k)
    return best.join(names, label, "left").select(doc, F.coalesce("name", F.col(label).cast("string")).alias("name"), "p", "rank")
