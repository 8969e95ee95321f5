"""Approximate nearest neighbours by balanced posting lists and a graph of their centroids.

Largest inner product becomes nearest distance by one more dimension, that lifts all
vectors to one length. Vectors are banded by length first (each band is lifted to its own
longest), so that a few very long ones don't squeeze the rest together.

* Fit, on a bounded sample: each band is halved at the median of the direction that parts
  it, again and again, so that its lists are equally large; neighbouring lists have
  neighbouring numbers. A list's centroid is the mean of its sample.
* Centroids are few and are searched by a graph in the memory of each task: links to the
  nearest and to some far centroids, the closest unvisited ones expanded first.
* Every vector enters its nearest list, and also those hardly further away (``NEAR``), unless
  the list is close to one already taken.
* A query visits the lists whose centroids are within a ratio of the distance of its nearest ones.
  The ratio is not guessed: ``PROBES`` queries are compared with all vectors, and the least
  ratio is taken at which their lists hold ``RECALL`` of the true neighbours.
* Consecutive lists make a group, that is cut into blocks of bounded size. A block meets
  each query that visits one of its lists once, by matrix products list by list; a vector
  that stands in several visited lists is scored once.

Equal vectors are one vector with its smallest ids (no result needs more of them), so
copies neither fill lists nor repeat work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, forget, stored, table

#: Vectors that a list is made for, and most lists of a band.
LIST, LISTS = 96, 16_384
#: Vectors of the fitted sample for each list, and most numbers in the sample.
EACH, SAMPLE = 16, 1 << 24
#: Rounds in which centroids settle.
ROUNDS = 4
#: Bands by length: each halves the one before, the last has all that is shorter.
BANDS = 4
#: Lists of a vector at most, the distance ratio up to which it enters a further one, and the
#: part of its squared distance that the further one must be away from those taken.
COPIES, NEAR, APART = 4, 1.05, 0.5
#: Links of a centroid to near and to far ones.
LINKS, FAR = 24, 8
#: Queries that calibrate the ratio, the recall that it is calibrated to, and what is added for the graph's misses.
PROBES, RECALL, SLACK = 256, 0.96, 0.005
#: Centroids that a search keeps or expands at least; that one for the nearest and one for all
#: within a distance expand at a time.
BEAM, WIDE, WIDER = 16, 4, 32
#: A query's distances are held against that of its centroid of this rank: the very nearest
#: one's says more of chance than of the place.
STEADY = 4
#: Part of the length below which a distance counts as that.
LEAST_FAR = 0.02
#: An empty place of a beam.
NONE = np.iinfo(np.int64).max
#: Lists of a group, and bytes of vectors of a block.
GROUP, BLOCK = 32, 32 << 20
#: Queries that are compared with a list at a time.
TILE = 2048


class Band(NamedTuple):
    """Lists of vectors of about one length: ``long`` is the longest, ``first`` the number of the first list."""

    long: float
    first: int
    centroids: np.ndarray
    links: np.ndarray
    doors: np.ndarray


# ---------------------------------------------------------------- fit


def halves(x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Row numbers of ``lists`` equally large parts, by cuts at the median of the
    direction between two means."""
    done, todo = [], [(np.arange(len(x)), lists)]
    while todo:
        rows, k = todo.pop()
        if k <= 1 or len(rows) < 2:
            done.append(rows)
            continue
        own = x[rows]
        a = own[0]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        for _ in range(4):
            to_a = own @ (a - b) > (a @ a - b @ b) / 2
            if to_a.all() or not to_a.any():
                break
            a, b = own[to_a].mean(axis=0), own[~to_a].mean(axis=0)
        left = k // 2
        order = np.argsort(own @ (a - b), kind="stable")
        cut = len(rows) * left // k
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], k - left)]
    return done


def settled(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of balanced lists: halves first, then rounds in which the sample goes to its
    nearest centroid; what has become larger than two lists is halved again."""
    centroids = np.stack([x[rows].mean(axis=0) for rows in halves(x, lists)])
    for turn in range(ROUNDS if len(centroids) > 1 else 0):
        norms = np.einsum("ij,ij->i", centroids, centroids)
        own = np.concatenate([(norms - 2 * x[at : at + 1024] @ centroids.T).argmin(axis=1) for at in range(0, len(x), 1024)])
        order = np.argsort(own, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
        usual = max(1, len(x) // lists)
        cut = [p for rows in parts for p in ([rows[h] for h in halves(x[rows], len(rows) // usual)] if len(rows) > 2 * usual else [rows])]
        centroids = np.stack([x[rows].mean(axis=0) for rows in cut])
    return centroids[halves_order(centroids)]


def halves_order(c: np.ndarray) -> np.ndarray:
    """An order in which neighbours in space are near."""
    return np.concatenate(halves(c, max(1, len(c) // 2)))


def linked(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, doors) of centroids: of each the nearest and some spread ones; the doors
    are where a search begins."""
    n, rng = len(c), np.random.default_rng(0)
    near = min(LINKS, n - 1)
    links = np.zeros((n, near + (FAR if n > 1 else 0)), np.int64)
    norms = (c * c).sum(axis=1)
    for at in range(0, n, 1024):
        own = norms - 2 * c[at : at + 1024] @ c.T
        rows = np.arange(at, at + len(own))
        own[rows - at, rows] = np.inf
        if near:
            links[rows, :near] = np.argpartition(own, near - 1, axis=1)[:, :near]
            links[rows, near:] = rng.integers(0, n, (len(own), FAR))
    return links, rng.permutation(n)[: max(1, int(np.sqrt(n)))]


def lift(x: np.ndarray, long: float) -> np.ndarray:
    """Vectors of the band with the dimension that lifts them to length ``long``."""
    rest = np.sqrt(np.maximum(long * long - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


def aimed(q: np.ndarray, long: float) -> np.ndarray:
    """Queries at length ``long``: the order of their neighbours doesn't depend on their own."""
    norms = np.sqrt(np.einsum("ij,ij->i", q, q))
    return np.hstack([q * (long / norms)[:, None], np.zeros((len(q), 1))]).astype(np.float32)


def band_of(norms: np.ndarray, longest: float) -> np.ndarray:
    return np.clip(np.floor(np.log2(longest / norms)), 0, BANDS - 1).astype(np.int64)


def fit(sample: np.ndarray, n: int, longest: float) -> list[Band]:
    """Bands of lists for ``n`` vectors, of which ``sample`` are some."""
    bands, first = [], 0
    own = band_of(np.sqrt(np.einsum("ij,ij->i", sample, sample)), longest)
    for b in range(BANDS):
        x, long = sample[own == b], longest * 0.5**b
        lists = max(1, min(LISTS, round(n * len(x) / max(1, len(sample)) / LIST), len(x) // (EACH // 2)))
        # a band that the sample misses has one list, which every query visits
        x = lift(x, long) if len(x) else np.zeros((1, sample.shape[1] + 1), np.float32)
        centroids = settled(x, lists)
        bands.append(Band(long, first, centroids, *linked(centroids)))
        first += -(-len(centroids) // GROUP) * GROUP
    return bands


# ---------------------------------------------------------------- graph


def reach(far: np.ndarray, long: float) -> np.ndarray:
    """The distances, a row a query, that ratios are of: of the ``STEADY``th nearest centroid,
    but not next to nothing."""
    rank = min(STEADY, far.shape[1]) - 1
    return np.maximum(np.partition(far, rank, axis=1)[:, rank : rank + 1], LEAST_FAR * long)


def closest(band: Band, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, distances) of the ``BEAM`` centroids nearest to each vector, in order: a beam
    of the best so far, whose first unexpanded ones are expanded until none is left."""
    c, n = band.centroids, len(band.centroids)
    square, norms = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)

    def keyed(rows: np.ndarray, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        # distance, number and "not expanded" in one number that sorts by them
        d = np.maximum(square[rows][:, None] + norms[at] - 2 * far, 0).astype(np.float32)
        return d.view(np.int32).astype(np.int64) << 32 | at << 1 | 1

    every = np.arange(len(x))
    beam = np.full((len(x), BEAM), NONE)
    first = np.sort(keyed(every, np.broadcast_to(band.doors, (len(x), len(band.doors))), x @ c[band.doors].T), axis=1)[:, :BEAM]
    beam[:, : first.shape[1]] = first
    live = every if n > len(band.doors) else every[:0]
    while len(live):
        own = beam[live]
        fresh = (own & 1 == 1) & (own != NONE)
        nth = fresh.cumsum(axis=1)
        going = nth[:, -1] > 0
        live, own, fresh, nth = live[going], own[going], fresh[going], nth[going]
        if not len(live):
            break
        place = np.argsort(~(fresh & (nth <= WIDE)), axis=1, kind="stable")[:, :WIDE]
        chosen = np.take_along_axis(own, place, 1)
        open_ = np.take_along_axis(fresh, place, 1)
        np.put_along_axis(own, place, np.where(open_, chosen & ~1, chosen), 1)
        at = np.where(open_[:, :, None], band.links[(chosen >> 1 & 0x7FFFFFFF) % n], band.doors[0]).reshape(len(live), -1)
        both = np.sort(np.hstack([own, keyed(live, at, np.einsum("ij,ikj->ik", x[live], c[at]))]), axis=1)
        # what was there already comes before its repetition
        both[:, 1:][both[:, 1:] >> 1 == both[:, :-1] >> 1] = NONE
        beam[live] = np.sort(both, axis=1)[:, :BEAM]
    lists = np.where(beam == NONE, -1, beam >> 1 & 0x7FFFFFFF)
    far = np.where(beam == NONE, np.inf, np.sqrt((beam >> 32).astype(np.int32).view(np.float32)))
    return lists, far


def visited(band: Band, x: np.ndarray, ratio: float) -> np.ndarray:
    """(rows, lists) distances to the centroids that a search from the doors comes across,
    infinite to others: open centroids are expanded, the closest first, while they are
    within ``ratio`` of the reach or fewer than ``BEAM`` were expanded."""
    c, n = band.centroids, len(band.centroids)
    square, norms = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
    found = np.full((len(x), n), np.inf, np.float32)
    found[:, band.doors] = np.maximum(square[:, None] + norms[band.doors] - 2 * x @ c[band.doors].T, 0)
    open_, expanded = found.copy(), np.zeros(len(x), np.int64)
    wide, live = min(WIDER, n), np.arange(len(x) if n > len(band.doors) else 0)
    while len(live):
        own = open_[live]
        at = np.argpartition(own, wide - 1, axis=1)[:, :wide]
        far = np.take_along_axis(own, at, 1)
        limit = (ratio * reach(np.sqrt(found[live]), band.long)) ** 2
        want = np.isfinite(far) & ((far <= limit) | (expanded[live] < BEAM)[:, None])
        going = want.any(axis=1)
        live, at, want = live[going], at[going], want[going]
        expanded[live] += want.sum(axis=1)
        rows, columns = np.nonzero(want)
        own = at[rows, columns]
        open_[live[rows], own] = np.inf
        pairs = np.unique(live[rows].repeat(band.links.shape[1]) * n + band.links[own].ravel())
        pairs = pairs[np.isinf(found.ravel()[pairs])]
        r, k = pairs // n, pairs % n
        found[r, k] = open_[r, k] = np.maximum(square[r] + norms[k] - 2 * np.einsum("ij,ij->i", x[r], c[k]), 0)
    return np.sqrt(found)


def entered(band: Band, x: np.ndarray) -> list[np.ndarray]:
    """Lists of each vector: the nearest, and others nearly as near that lie in other directions."""
    out = []
    for at in range(0, len(x), 512):
        lists, far = closest(band, x[at : at + 512])
        c = band.centroids[lists]
        norms = np.einsum("ijk,ijk->ij", c, c)
        between = norms[:, :, None] + norms[:, None] - 2 * c @ c.transpose(0, 2, 1)
        near = (lists >= 0) & (far <= NEAR * np.maximum(far[:, :1], LEAST_FAR * band.long))
        taken = np.zeros(lists.shape, bool)
        taken[:, 0] = True
        for j in range(1, lists.shape[1]):
            apart = (between[:, j] > APART * np.where(near[:, j], far[:, j], 0)[:, None] ** 2) | ~taken
            taken[:, j] = near[:, j] & (taken.sum(axis=1) < COPIES) & apart.all(axis=1)
        out += [row[t] + band.first for row, t in zip(lists, taken, strict=True)]
    return out


# ---------------------------------------------------------------- tables


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda c: c != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, d) numbers of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(vec, ids): every different vector with its ``ids`` smallest ids. The limit by rank
    acts before the shuffle, so a vector that recurs often is not gathered."""
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    # repeated rows are one
    return rows.distinct().withColumn("_n", first).where(F.col("_n") <= ids).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _enter(bands, longest: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x = matrix(b.column(0))
        own = band_of(np.sqrt(np.einsum("ij,ij->i", x, x)), longest)
        lists: list = [None] * len(x)
        for k, band in enumerate(bands.value):
            at = np.flatnonzero(own == k)
            if len(at):
                for i, found in zip(at, entered(band, lift(x[at], band.long)), strict=True):
                    lists[i] = found
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["vec", "ids", "lists"])


def _truth(probes, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``top`` vectors of a partition for each probe, with the lists they are in."""
    q = probes.value
    score, lists = np.empty((len(q), 0)), np.empty(0, object)
    held = np.empty((len(q), 0), np.int64)
    for b in batches:
        if b.num_rows:
            own = q @ matrix(b.column(0)).T
            held = np.hstack([held, np.broadcast_to(np.arange(len(lists), len(lists) + own.shape[1]), own.shape)])
            score = np.hstack([score, own])
            lists = np.concatenate([lists, np.fromiter(b.column(2).to_pylist(), object, b.num_rows)])
            if score.shape[1] > top:
                at = np.argpartition(-score, top - 1, axis=1)[:, :top]
                score, held = np.take_along_axis(score, at, 1), np.take_along_axis(held, at, 1)
                used, held = np.unique(held, return_inverse=True)
                held, lists = held.reshape(score.shape), lists[used]
    if score.size:
        probe = np.arange(len(q)).repeat(score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int32()), pa.array(score.ravel()), pa.array(lists[held.ravel()].tolist(), pa.list_(pa.int32()))], ["probe", "score", "lists"])


def calibrated(entries: DataFrame, probes: np.ndarray, bands: list[Band], top: int, recall: float = RECALL) -> float:
    """The least ratio at which the lists within it hold ``recall`` of the ``top`` true
    neighbours of the probes, the probes' own vectors not counted."""
    spark = entries.sparkSession
    found = entries.mapInArrow(partial(_truth, spark.sparkContext.broadcast(probes), top + 1), "probe int, score double, lists array<int>")
    best = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))
    rows = found.withColumn("_n", best).where(F.col("_n") <= top + 1).select("probe", "score", "lists").collect()
    own = np.einsum("ij,ij->i", probes, probes)
    needed = []
    ratios = []
    for b in bands:
        d = _far(aimed(probes, b.long), b.centroids)
        ratios.append(d / reach(d, b.long))
    for r in rows:
        if abs(r.score - own[r.probe]) <= 1e-9 * own[r.probe]:
            continue
        k = max(i for i, b in enumerate(bands) if b.first <= r.lists[0])
        needed.append(min(ratios[k][r.probe][at - bands[k].first] for at in r.lists))
    return float(np.quantile(needed, recall, method="higher")) + SLACK if needed else 1 + SLACK


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def _dealt(blocks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector with those of its lists that are in a group, once for each group."""
    for b in batches:
        take, group, part, own = [], [], [], []
        for i, (lists, ids) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)):
            for g in sorted({k // GROUP for k in lists}):
                take.append(i)
                group.append(g)
                part.append(ids[0] * 0x9E3779B1 % (1 << 32) % blocks.value[g])
                own.append([k % GROUP for k in lists if k // GROUP == g])
        at = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(group, pa.int32()), pa.array(part, pa.int32()), pa.nulls(len(take), pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(own, pa.list_(pa.int32()))],
            ["grp", "part", "query", "vec", "ids", "lists"],
        )


def _asked(bands, blocks, ratio: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query with the lists it visits in a group, once for each block of it."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            x = matrix(part.column(1))
            for band in bands.value:
                d = visited(band, aimed(x, band.long), ratio)
                rows, lists = np.nonzero(d <= ratio * reach(d, band.long))
                lists += band.first
                if not len(rows):
                    continue
                # a query and a group: neighbours, as rows and lists are in order
                starts = np.flatnonzero(np.diff(rows * (1 << 32) + lists // GROUP, prepend=-1))
                groups = lists[starts] // GROUP
                own = pa.ListArray.from_arrays(pa.array([*starts, len(lists)], pa.int32()), pa.array(lists % GROUP, pa.int32()))
                many = np.array([blocks.value.get(g, 0) for g in groups.tolist()], np.int64)
                take = pa.array(np.arange(len(starts)).repeat(many))
                query = pa.array(rows[starts].repeat(many))
                piece = np.arange(many.sum()) - (many.cumsum() - many).repeat(many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups.repeat(many), pa.int32()), pa.array(piece, pa.int32()), part.column(0).take(query), part.column(1).take(query), pa.nulls(len(take), pa.list_(pa.int64())), own.take(take)],
                    ["grp", "part", "query", "vec", "ids", "lists"],
                )


class Block:
    """Vectors of a block, each with the lists of the group that it is in."""

    def __init__(self, x: np.ndarray, ids: list, lists: np.ndarray):
        self.x, self.ids = x, ids
        self.held = lists
        # a vector is scored in the first of its lists that the query visits
        self.rows = [np.flatnonzero(lists[:, k]) for k in range(GROUP)]

    def nearest(self, q: np.ndarray, asked: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the ``top`` best of each query in the lists it visits."""
        best = np.full((len(q), top), -np.inf)
        which = np.full((len(q), top), -1, np.int64)
        for k in range(GROUP):
            rows, queries = self.rows[k], np.flatnonzero(asked[:, k])
            if not len(rows) or not len(queries):
                continue
            score = q[queries] @ self.x[rows].T
            if k:
                score[asked[queries, :k].astype(np.float32) @ self.held[rows, :k].T.astype(np.float32) > 0] = -np.inf
            score = np.hstack([best[queries], score])
            at = np.argpartition(-score, top - 1, axis=1)[:, :top]
            best[queries] = np.take_along_axis(score, at, 1)
            which[queries] = np.take_along_axis(np.hstack([which[queries], np.broadcast_to(rows, (len(queries), len(rows)))]), at, 1)
        query, place = np.nonzero(which >= 0)
        vector = which[query, place]
        # the same sum whatever the block, so equal pairs of several groups are equal
        return query, vector, np.einsum("ij,ij->i", q[query], self.x[vector])


def _marks(column: list) -> np.ndarray:
    out = np.zeros((len(column), GROUP), bool)
    for i, own in enumerate(column):
        out[i, own] = True
    return out


def _meet(top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, its vectors before its queries: only the vectors of one block are held."""
    key, parts, block = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
        asks = ~np.asarray(b.column(2).is_null())
        # stretches of one block and one kind
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for at, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            own = b.slice(at, end - at)
            if keys[at] != key:
                key, parts, block = keys[at], [], None
            if not asks[at]:
                parts.append((matrix(own.column(3)), own.column(4).to_pylist(), _marks(own.column(5).to_pylist())))
                continue
            if block is None and parts:
                block = Block(np.vstack([p[0] for p in parts]), [i for p in parts for i in p[1]], np.vstack([p[2] for p in parts]))
                parts = []
            if block is None:
                continue
            for tile in range(0, own.num_rows, TILE):
                t = own.slice(tile, TILE)
                names = t.column(2).to_numpy()
                query, vector, score = block.nearest(matrix(t.column(3)), _marks(t.column(5).to_pylist()), top)
                ids = [block.ids[v] for v in vector]
                many = [len(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[query].repeat(many)), pa.array([i for own in ids for i in own], pa.int64()), pa.array(score.repeat(many))], ["query", "id", "score"]
                )


# ---------------------------------------------------------------- search


class Found(NamedTuple):
    """(query_id, rank, vec_id, score) and the ratio that the search was calibrated to."""

    rows: DataFrame
    ratio: float


def search(rows: DataFrame, asked: Column, top: int = 20, recall: float = RECALL, vector: str = "embedding", name: str = "vec_id") -> Found:
    """The ``top`` nearest rows of each row that ``asked`` holds for, by inner product.

    Vectors that are null, zero, of null or non-finite components, or of another length
    than most take no part, nor do rows without id. Equal rows count once; of rows with one
    id and different vectors each is a query and none a result for that id. Ties go to the
    smaller id. Where there are fewer candidates all are ranked; no rows give no rows.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    own = rows.select(F.col(name).cast("long").alias("id"), F.col(vector).alias("vec"), F.coalesce(asked, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("vec"))
    usual = own.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return Found(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 1.0)
    own = own.where(F.size("vec") == usual.d)
    vectors = stored(distinct_vectors(own.select("id", "vec"), top + 1), "vectors")
    n, longest = vectors.agg(F.count("*"), F.max(norm("vec"))).first()
    size = max(1, min(EACH * min(n // LIST + 1, LISTS), SAMPLE // usual.d))

    def drawn(df: DataFrame, total: int, want: int, seed: int) -> np.ndarray:
        """About ``want`` different vectors, the same in each run."""
        some = df.select("vec") if total <= want else df.where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * want / total)).select("vec")
        found = matrix(some.toArrow()["vec"].combine_chunks())
        return found[np.lexsort(found.T)] if len(found) else found

    sample = drawn(vectors, n, size, 1)
    if not len(sample):
        sample = drawn(vectors.orderBy("ids").limit(1), 1, 1, 1)
    bands = fit(sample, n, longest)
    shared = spark.sparkContext.broadcast(bands)
    entries = stored(vectors.mapInArrow(partial(_enter, shared, longest), f"vec {vectors.schema['vec'].dataType.simpleString()}, ids array<long>, lists array<int>"), "entries")
    forget(vectors)

    queries = stored(own.where("asks").groupBy("vec").agg(F.min("id").alias("query")).select("query", "vec"), "queries")
    # a vector under several ids is asked once, by its smallest; an id of several vectors needs a name of its own for each
    queries = queries.withColumn("key", F.xxhash64("query", "vec"))
    asking = queries.count()
    if not asking:
        return Found(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 1.0)
    probes = drawn(queries, asking, PROBES, 2)
    if not len(probes):
        probes = drawn(queries.orderBy("query").limit(1), 1, 1, 2)
    ratio = calibrated(entries, probes, bands, top, recall)

    groups = entries.select(F.explode(F.array_distinct(F.transform("lists", lambda k: F.floor(k / GROUP).cast("int")))).alias("grp")).groupBy("grp").count().collect()
    most = max(1, BLOCK // (8 * usual.d))
    blocks = spark.sparkContext.broadcast({r.grp: -(-r["count"] // most) for r in groups})
    kind = f"grp int, part int, query long, vec {entries.schema['vec'].dataType.simpleString()}, ids array<long>, lists array<int>"
    dealt = entries.mapInArrow(partial(_dealt, blocks), kind)
    sent = queries.select("key", "vec").mapInArrow(partial(_asked, shared, blocks, ratio), kind)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(blocks.value.values()))
    met = dealt.union(sent).repartition(count, "grp", "part").sortWithinPartitions("grp", "part", F.col("query").isNotNull(), "query")
    hits = met.mapInArrow(partial(_meet, top + 1), "key long, id long, score double")
    near = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("id")))), 1, 2 * top + 2)
    best = stored(hits.groupBy("key").agg(near.alias("near")), "nearest")
    # every id of a vector gets the list of the vector, less itself
    ids = own.where("asks").select("id", "vec").distinct().join(queries.select("vec", "key"), "vec").select("id", F.col("key").alias("_key"))
    out = ids.join(best.withColumnRenamed("key", "_key"), "_key")
    kept = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, top)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "s"))
    return Found(out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), (-F.col("s.s")).alias("score")), ratio)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).rows
