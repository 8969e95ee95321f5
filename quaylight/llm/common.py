"""Helpers shared by the training-data operators: reading tables, the shared
folder for intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting to remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of an Arrow batch: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Most rows that are sent to all executors; above it they are joined by shuffle.
SMALL = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.
    A local session without one (tests) gets a temporary one; a cluster's must name
    it, since a temporary folder of the driver is not seen by executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quaylight-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage
    is cut and nothing has to be recomputed when an executor goes. The shuffles of
    the write are removed as soon as the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, when all that was made of them is
    itself stored."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """``df``, to be sent to all executors if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def arrow_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, alike for all operators."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def packed(columns: list[str]) -> Column:
    """The columns in one struct, out of the way of the operators' own names."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``_row`` with the ``keep`` columns, and the text beside it if it isn't in it."""
    return docs.select(packed(keep), *([] if "text" in keep else [F.col("text").alias("_text")]))


def row_texts(batch: pa.RecordBatch) -> list[str | None]:
    """Texts of a batch of ``with_text``."""
    found = batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text")
    return found.to_pylist()


def n_words(text: str | Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
