"""Scans and sinks: parquet, ORC, CSV, TSV, JSON and their options."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a batch of a loader that asks for ids.
BATCH = 100
FORMATS = ("orc", "parquet", "csv", "json")


def load(spark: SparkSession, path: str, options: dict | None = None, schema: T.StructType | str | None = None, persist: bool = False, view: str | None = None) -> DataFrame:
    """SRC1, SRC2, SRC5, SRC6: reads ``fmt://path`` with that format, any other path
    as parquet; a scheme that names no format belongs to the path. Optionally kept
    in memory and registered as a temporary view."""
    scheme, mark, rest = path.partition("://")
    reader = spark.read.options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(scheme).load(rest) if mark and scheme in FORMATS else reader.format("parquet").load(path)
    df = df.persist() if persist else df
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_tsv(spark: SparkSession, path: str, names: list[str], required: list[str] | None = None) -> DataFrame:
    """SRC3: tab-separated with a header and inferred types, renamed, rows without
    the required columns and repeated rows dropped."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True).toDF(*names)
    return df.na.drop(subset=required or names).distinct()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. A local
    session without one gets a temporary one; a cluster's must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quaylight-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Rows of a small table, by its size in the plan, dealt to all cores: a file of one
    row group is read by one task. Larger tables have row groups enough."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(size) <= most else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for results that a plan uses several times:
    they are computed once, and not again when an executor goes. Its size in later plans
    is that of its files; a checkpoint keeps the estimate of the plan it cuts, which over
    rounds of joins grows until planning takes longer than the round."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` wrote, when nothing lazy reads them any more."""
    for t in tables:
        _drop(t.sparkSession, t._kept_at)


def _drop(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def batches(ids: DataFrame, key: str, size: int = BATCH) -> DataFrame:
    """SRC9, SRC10, SRC13: ids with the number of the batch that asks for them, gapless
    and in order; no id is in two batches."""
    from ..operators.relational import gapless_ids

    return gapless_ids(ids.select(key).distinct(), key, "_at").select(key, F.floor(F.col("_at") / size).cast("long").alias("batch"))


def bulk_query(source: str, entity: str, item: str, value: str, items: list[str]) -> str:
    """SRC11: one query for a list of items, a column each, instead of a query each."""
    name = lambda x: x.replace("`", "")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    columns = ", ".join(f"sum(CASE WHEN {item} = {text(x)} THEN {value} END) AS `{name(x)}`" for x in items)
    return f"SELECT {entity}, {columns} FROM {source} WHERE {item} IN ({', '.join(map(text, items))}) GROUP BY {entity}"


def sheet_rows(rows: DataFrame, ids: DataFrame, header: int = 1, base_row: bool = True, book: str = "sheet") -> DataFrame:
    """SRC8: rows (book, row, company, ...) of workbooks: header rows skipped, each book
    cut at its first blank company, the base's row left out, and the id sheet joined by
    company, and by book where it has one."""
    body = rows.where(F.col("row") >= header)
    blank = F.coalesce(F.trim("company"), F.lit("")) == ""
    ends = body.where(blank).groupBy(book).agg(F.min("row").alias("_end"))
    kept = body.join(ends, book, "left").where((F.col("_end").isNull() | (F.col("row") < F.col("_end"))) & (F.col("row") >= header + int(base_row)))
    return kept.drop("_end").join(ids, [c for c in (book, "company") if c in ids.columns], "left")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, f"{sf_dir}/{name}.parquet")


def lower_columns(df: DataFrame) -> DataFrame:
    """PRJ1: lower-case column names."""
    return df.toDF(*(c.lower() for c in df.columns))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    """PRJ2: a role's prefix on every column, for self-joins."""
    return df.toDF(*(prefix + c for c in df.columns))


def of_types(df: DataFrame, *types: str, skip: tuple[str, ...] = ()) -> list[str]:
    """PRJ13: names of the columns of some types, ids left out."""
    return [c for c, t in df.dtypes if t in types and not c.startswith("id") and c not in skip]


def save(df: DataFrame, path: str, mode: str = "error", fmt: str = "parquet", by: list[str] | None = None, **options) -> None:
    """SNK1, SNK2, SNK7, SNK9-11: writes in a format, optionally by the values of
    columns; an existing target is an error unless the mode says otherwise."""
    out = df.write.mode(mode).format(fmt).options(**options)
    (out.partitionBy(*by) if by else out).save(path)


def save_vocabulary(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK5: word, id and idf in sorted word order as CSV."""
    df.orderBy("word").write.mode(mode).csv(path, header=True)


#: Segments of one level that become one of the next.
MERGED = 4


def _segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def save_index(df: DataFrame, path: str, doc: str, tokens: str, mode: str = "append") -> None:
    """SNK3, SNK4: an inverted index in segments, in place of a search server's: an append
    writes postings of its own rows and the document frequencies that these add. Four
    segments of frequencies of one level are merged to one of the next, so there are few of
    them however many appends there were; postings are never read again. One writer at a time."""
    spark = df.sparkSession
    if mode == "overwrite":
        _drop(spark, path)
    elif mode != "append" and _segments(spark, path):
        raise ValueError(f"{path} has an index")
    own = f"segment={len(_segments(spark, f'{path}/postings')):08d}"
    postings = df.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    postings.write.parquet(f"{path}/postings/{own}")
    added = spark.read.parquet(f"{path}/postings/{own}").groupBy("term").agg(F.count("*").alias("df"))
    added.write.parquet(f"{path}/terms/segment=0-{own[8:]}")
    level = 0
    while len(few := [s for s in _segments(spark, f"{path}/terms") if s.startswith(f"segment={level}-")]) >= MERGED:
        parts = [f"{path}/terms/{s}" for s in few]
        merged = spark.read.parquet(*parts).groupBy("term").agg(F.sum("df").alias("df"))
        merged.write.parquet(f"{path}/terms/segment={level + 1}-{few[-1].split('-')[1]}")
        _drop(spark, *parts)
        level += 1


def index_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of an index over all its segments."""
    return spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"))


def json_lines(df: DataFrame) -> DataFrame:
    """SNK9: each row as a JSON line."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
