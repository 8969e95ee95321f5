"""Multi-set projection: several tables about the same rows, brought into one space."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of the products of two different blocks, and places that products are rounded to.
CROSS, PLACES = 60.0, 2


def widths(df: DataFrame, blocks: list[str]) -> list[int]:
    """The longest vector of each block column; 0 where there is none."""
    found = df.agg(*(F.max(F.size(b)).alias(f"_{i}") for i, b in enumerate(blocks))).first()
    return [max(0, n or 0) for n in found]


def _dense(columns: list[pa.Array], sizes: list[int]) -> np.ndarray:
    """The blocks of a batch beside each other. Null vectors and entries are zero, short
    vectors end in zeros."""
    out = np.zeros((len(columns[0]), sum(sizes)))
    start = 0
    for column, size in zip(columns, sizes, strict=True):
        lengths = np.diff(column.offsets.to_numpy())
        lengths[np.asarray(column.is_null())] = 0
        values = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        rows = np.arange(len(column)).repeat(lengths)
        out[rows, start + np.arange(len(rows)) - (lengths.cumsum() - lengths).repeat(lengths)] = values
        start += size
    return out


def _products(sizes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's share of the products of all columns with all, one row a column."""
    total = np.zeros((sum(sizes), sum(sizes)))
    for b in batches:
        x = _dense(b.columns, sizes)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the arrays of equal numbers, which come one after the other."""
    last, total = None, None
    for b in batches:
        for i, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            row = row.values.to_numpy(zero_copy_only=False)
            if i != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])
                last, total = i, np.zeros(len(row))
            total = total + row
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "row"])


def products(df: DataFrame, blocks: list[str], sizes: list[int]) -> np.ndarray:
    """The products of all columns of all blocks: as many rows and columns as the blocks have
    columns, whatever the rows of ``df``."""
    parts = df.select(*blocks).mapInArrow(partial(_products, sizes), "i int, row array<double>")
    sums = parts.repartition(min(64, sum(sizes)), "i").sortWithinPartitions("i").mapInArrow(added, "i int, row array<double>")
    out = np.zeros((sum(sizes), sum(sizes)))
    for r in sums.collect():
        out[r.i] = r.row
    return out


def axes(gram: np.ndarray, sizes: list[int], k: int, cross: float = CROSS) -> np.ndarray:
    """(columns, k) eigenvectors of the block matrix, by falling eigenvalue. Products within a
    block weigh one over the number of blocks, those between two blocks ``cross``. The largest
    entry of each is positive; of equally large ones the first. An axis whose eigenvalue is
    negative is zero: in blocks padded to one width, axes of the padding come before it."""
    own = np.arange(len(sizes)).repeat(sizes)
    weighed = np.round(np.where(own[:, None] == own, 1 / len(sizes), cross) * gram, PLACES)
    values, vectors = np.linalg.eigh((weighed + weighed.T) / 2)
    vectors = (vectors * (values > -1e-9 * max(1.0, abs(values[-1]))))[:, ::-1][:, :k]
    largest = np.abs(vectors).max(axis=0) * (1 - 1e-9)
    return vectors * np.sign(vectors[(np.abs(vectors) >= largest).argmax(axis=0), np.arange(vectors.shape[1])])


def _projected(sizes: list[int], to: np.ndarray, places: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _dense(b.columns[1:], sizes) @ to / len(sizes)
        found = found if places is None else np.round(found, places) + 0.0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["_key", "projected"])


def coordinates(df: DataFrame, key: str, blocks: list[str], sizes: list[int], to: np.ndarray, places: int | None = None) -> DataFrame:
    """(key, projected): the mean over the blocks of their products with their rows of ``to``."""
    out = df.select(F.col(key).alias("_key"), *blocks).mapInArrow(partial(_projected, sizes, to, places), f"_key {df.schema[key].dataType.simpleString()}, projected array<double>")
    return out.select(F.col("_key").alias(key), "projected")


def multi_set_projection(df: DataFrame, key: str, blocks: list[str], k: int, cross: float = CROSS) -> DataFrame:
    """VEC19: (key, projected) of rows that have a vector in each of the ``blocks`` columns:
    the mean over the blocks of their products with the block's part of the ``k`` leading
    axes, to 4 places. Null vectors and entries count as zeros; no rows give no rows, and
    blocks without columns give empty vectors. The driver holds a matrix of all columns."""
    sizes = widths(df, blocks)
    to = axes(products(df, blocks, sizes), sizes, min(k, sum(sizes)), cross) if sum(sizes) else np.zeros((0, 0))
    return coordinates(df, key, blocks, sizes, to, 4)


def aligned(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables beside each other, those that all of them have."""
    return reduce(lambda a, b: a.join(b, key), tables)
