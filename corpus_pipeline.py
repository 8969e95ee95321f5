"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import decontaminate, mixing, nearsets, sharding, toxicity
from quaylight.llm.common import forget, stored, table, unpacked

#: A document at or above this score goes.
TOXIC = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the multiple-instance model, trained on the labels of
    this stage's own documents, scores as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model, docs.columns).where(F.col("_score") < TOXIC).select(*unpacked(docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the
    document with the smallest doc_id."""
    return nearsets.keep_one(docs, k=5, like=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come to their target weights, better
    texts first; a document taken twice is two rows."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0, measure=mixing.text_counts("text"), size=lambda m: m["words"], quality=mixing.prose_weight)
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*unpacked(docs.columns))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, in place of columns of these names: 24 shards of near equal
    bytes, equal texts together."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    out = sharding.shard(docs, size=size, group=sharding.text_group("text"), shards=24)
    return out.select(*unpacked([c for c in docs.columns if c.lower() not in ("shard", "slot")]), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The fitted classifier and the hash-keyed sample have no SQL form. Tests hold near-duplicates,
#: matches of the benchmark and the mix's targets against brute force, and the toxicity stage
#: against held-out labels; of the sharding they check the laws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
