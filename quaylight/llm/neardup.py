"""SimHash near-duplicates, compared by bit planes.

A fingerprint is 64 bits. Within radius r two fingerprints agree wholly on one
of r+1 blocks (or on p of r+p blocks), so rows meet in block buckets and nothing
within the radius is missed. In a bucket, fingerprints lie vertically: word w of
plane b holds bit b of 64 fingerprints. A query is compared with 64 of them at a
time by carry-save counters, one bit plane after another, and blocks in which
every lane is beyond the radius are dropped on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, stored, table
from .components import connected_components

BITS = 64
#: Most fingerprints on one side of a comparison task.
CHUNK = 4096
#: Most rows that a bucket should hold on average; above it more blocks must agree.
BUCKET = 16384

_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(raw: bytes, k: int) -> int:
    """Fingerprint of a text: a bit is set if it is in over half the hashes of
    the k-word shingles (repeats included) of the A-Z lower-cased text. A text of
    fewer words is one shingle; a text of none has fingerprint zero."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < k:
        return _xxh(b" ".join(words))
    counts, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        own = words[at : at + (1 << 16) + k - 1]
        h = np.fromiter(map(_xxh, map(b" ".join, zip(*(own[i:] for i in range(k)), strict=False))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column(1).cast(pa.binary()).to_pylist()
        fps = np.fromiter((simhash(x or b"", k) for x in raw), np.uint64, len(raw))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of uint64 values."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(np.uint64)


def _beyond(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    more, same = over.copy(), ~np.zeros_like(over)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same &= counter[i]
        else:
            more |= same & counter[i]
            same &= ~counter[i]
    return more


def close(queries: np.ndarray, table: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (of queries, of the n values in bit planes) at most radius apart.
    Values of more than 64 bits are rows of words, with the planes of each word
    after those of the one before."""
    width = max(1, radius.bit_length())
    q = np.repeat(np.arange(len(queries)), table.shape[1])
    w = np.tile(np.arange(table.shape[1]), len(queries))
    places = np.arange(BITS, dtype=np.uint64)[:, None]
    masks = np.concatenate([np.uint64(0) - (x[None, :] >> places & np.uint64(1)) for x in queries.reshape(len(queries), -1).T])
    counter, over = [np.zeros(len(q), np.uint64) for _ in range(width)], np.zeros(len(q), np.uint64)
    for b in range(len(table)):
        carry = table[b][w] ^ masks[b][q]
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if b % 16 == 15 or b == 23:
            live = _beyond(counter, over, radius) != ~np.uint64(0)
            if not live.all():
                q, w, over, counter = q[live], w[live], over[live], [c[live] for c in counter]
            if not len(q):
                break
    near = ~_beyond(counter, over, radius)
    hit = np.nonzero(near)[0]
    lanes = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    i, j = q[hit][at], w[hit][at] * 64 + lane
    return i[j < n], j[j < n]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the edges."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _stars(fp: np.ndarray, rep: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links of one bucket (or of two of its chunks)
    connect: every linked row with one row of its component."""
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    if not len(right):
        right = left
    index, ii, jj = planes(fp[right]), [], []
    for at in range(0, len(left), 256):
        i, j = close(fp[left[at : at + 256]], index, len(right), radius)
        i, j = left[at + i], right[j]
        keep = i < j if right is left else slice(None)
        ii.append(i[keep])
        jj.append(j[keep])
    i, j = np.concatenate(ii), np.concatenate(jj)
    root = _roots(len(fp), i, j)
    own = np.nonzero(root != np.arange(len(fp)))[0]
    return rep[own], rep[root[own]]


def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and tile, so each group is a run."""
    held: list[np.ndarray] = []

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, tile, side, fp, rep = cols
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in np.flatnonzero(np.diff(cut) > 1):
            s = slice(cut[a], cut[a + 1])
            u, v = _stars(fp[s].view(np.uint64), rep[s], side[s], radius)
            us.append(u)
            vs.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]) and (held[0][0], held[1][0]) != (held[0][-1], held[1][-1]):
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1] + 1
            yield out([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held and len(held[0]):
        yield out(held)


def block_tables(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (start, length) whose agreement makes a bucket, one list a
    table. Of radius+p blocks, p agree whenever two fingerprints are within the
    radius; p is the least that keeps buckets of n random rows small."""
    p = 1
    while n / 2 ** (BITS * p / (radius + p)) > BUCKET and p < 6:
        p += 1
    edges = [BITS * i // (radius + p) for i in range(radius + p + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(blocks, p)]


def _bucket(no: int, ranges: list[tuple[int, int]]):
    parts = [F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << n) - 1}L") for a, n in ranges]
    return F.xxhash64(F.lit(no), *parts)


def fingerprint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between rows of ``fps`` (distinct fp, rep) that connect all
    rows linked within the radius: for each bucket a spanning star, not all pairs.
    Buckets above CHUNK rows are cut into chunks that meet pairwise, each pair in
    a task of its own."""
    spark = fps.sparkSession
    tables = block_tables(fps.count(), radius)
    rows = fps.select("fp", "rep", F.explode(F.array(*(_bucket(i, r) for i, r in enumerate(tables)))).alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("bucket", F.ceil(F.col("n") / CHUNK).alias("k"))
    cut = rows.join(hot, "bucket", "left").select("bucket", "fp", "rep", F.coalesce("k", F.lit(1)).alias("k"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), "k"))
    cut = cut.select("bucket", "fp", "rep", "own", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    tiled = cut.select("bucket", (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "rep")
    dealt = tiled.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "side")
    return dealt.mapInArrow(partial(_links, radius), "u long, v long")


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Equal fingerprints are grouped before anything is compared, so copies cost
    one row each; component_id is the smallest doc_id reachable over links of at
    most ``radius`` bits. Null and blank texts have fingerprint zero and are
    linked like any other. Rows that repeat a doc_id each keep a row; a null doc_id
    is linked like any other, but a component's name only where it has no other.
    Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = stored(docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, k), "doc_id long, fp long"), "fp")
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    links = stored(fingerprint_links(fps.select("fp", F.col("fp").alias("rep")), radius), "links")
    # Components are of fingerprints; their names are the least ids among them.
    found = stored(connected_components(links), "components").join(fps, F.col("node") == F.col("fp"))
    least = found.groupBy("component").agg(F.min("rep").alias("least")).select(F.bitwise_not("component").alias("_key"), "least")
    linked = found.withColumn("_key", F.bitwise_not("component")).join(least, "_key").select("fp", "least", F.lit(True).alias("linked"))
    names = fps.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return own.join(stored(names, "names"), "fp").select("doc_id", "fp", "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
