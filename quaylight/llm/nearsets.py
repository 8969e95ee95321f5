"""Near-duplicate texts by SimHash with an exact check.

Documents meet by the shingles that a pair of the asked similarity can't avoid
sharing: of a set in one common order the first size - ceil(like * size) + 1, rare
shingles first. Where they meet, 256-bit fingerprints are compared by bit planes
within a radius that loses no pair (``sketch``), and the sets of those in it are
compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_batches, forget, packed, small, stored, unpacked
from .components import connected_components
from .neardup import _roots, close, planes
from .sketch import LONG, WORDS, digests, distances, longest_partner, parity, parity_radius, simhash, simhash_radius

#: Most fingerprints that are compared with one another at a time.
CHUNK = 4096
#: Most documents on one side of an exact comparison.
TILE = 1024
#: Rows of a group above that size that all its rows are compared with first, about.
PIVOTS = 16
#: One document in so many is looked at to find frequent shingles.
SAMPLE = 64
#: Documents of that sample that a frequent shingle is in at least, and how many
#: shingles are ordered by frequency at most. Both change the work, not the result.
OFTEN, RANKED = 4, 200_000
#: Groups of so many fingerprints or fewer are compared pair by pair.
FEW = 16
#: What is told apart from the keys of long sets.
SHORT = np.uint64(0x9E3779B97F4A7C15)

#: Sorted names of shingles and their counts.
Frequent = tuple[np.ndarray, np.ndarray]


def shingle_digests(raw: bytes, k: int) -> np.ndarray:
    """Digests of the distinct k-word shingles of the A-Z lower-cased text. Fewer
    words are one shingle, none is none."""
    words = raw.lower().split()
    if not words:
        return np.zeros((0, 32), np.uint8)
    if len(words) <= k:
        return digests([b" ".join(words)])
    return digests(list(set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))))


def keys_of(d: np.ndarray) -> np.ndarray:
    """Sorted 64-bit names of digests."""
    return np.sort(np.ascontiguousarray(d[:, 8:16]).view(np.uint64).ravel())


def prefix(shingles: np.ndarray, like: float, frequent: Frequent | None = None) -> np.ndarray:
    n = len(shingles)
    if frequent and n and len(frequent[0]):
        names, counts = frequent
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(names[at] == shingles, counts[at], 0)))]
    return shingles[: n - math.ceil(like * n - 1e-9) + 1]


def _all_keys(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [keys_of(shingle_digests(raw, k)) for raw in batch.column(0).to_pylist()]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["key"])


def _meetings(k: int, like: float, frequent: Frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle that a document is met by. Sets around LONG shingles
    are met twice, by parities and by SimHash, so that any pair has one in common."""
    names = ["key", *(f"f{i}" for i in range(WORDS)), "n", "doc_id"]
    reach = longest_partner(LONG, like)
    for batch in batches:
        keys, fps, sizes, ids = [], [], [], []

        def met(d, at, fp, n):
            keys.append(at)  # noqa: B023
            fps.append(np.tile(fp, (len(at), 1)))  # noqa: B023
            sizes.append(np.full(len(at), n, np.int32))  # noqa: B023
            ids.append(np.full(len(at), d, np.int64))  # noqa: B023

        for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = shingle_digests(raw, k)
            n = len(own)
            first = prefix(keys_of(own), like, frequent)
            if n >= LONG:
                met(d, first, simhash(own), n)
            if n <= reach:
                met(d, first ^ SHORT, parity(own), n)
        if keys:
            fp = np.concatenate(fps)
            cols = (pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (np.concatenate(keys), *fp.T))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ids))], names)


def _alike(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, like: float) -> np.ndarray:
    """Which pairs may be as similar as asked, by sizes and fingerprints. Rows of one
    key are all parities or all SimHashes; two long sets that meet by parities are
    within the radius of either."""
    a, b = n[i], n[j]
    ok = np.minimum(a, b) >= like * np.maximum(a, b) - 1e-9
    return ok & (distances(fp[i], fp[j]) <= np.where(np.minimum(a, b) >= LONG, simhash_radius(like), parity_radius(a + b, like)))


def _near(fp: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left, of right) that ``_alike`` admits: in bit planes of all words
    within the widest radius among them, then each by its own."""
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(left) or not len(right):
        return ii[0], jj[0]
    index = np.concatenate([planes(np.ascontiguousarray(fp[right, w])) for w in range(WORDS)])
    both = min(int(n[left].max() + n[right].max()), LONG + longest_partner(LONG, like))
    radius = max(int(parity_radius(both, like)), simhash_radius(like) if min(n[left].max(), n[right].max()) >= LONG else 0)
    for at in range(0, len(left), 128):
        own = left[at : at + 128]
        i, j = close(fp[own], index, len(right), min(radius, 64 * WORDS - 1))
        i, j = own[i], right[j]
        keep = (i != j) & _alike(fp, n, i, j, like)
        ii.append(i[keep])
        jj.append(j[keep])
    return np.concatenate(ii), np.concatenate(jj)


def _candidates(like: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the documents of each key and tile that may be similar. Rows come
    sorted by key and tile."""
    held: list[np.ndarray] = []
    count = 5 + WORDS

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, tile, side, n, ids, *words = cols
        fp = np.stack(words, axis=1).view(np.uint64)
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        sizes = np.diff(cut)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= FEW) & (tile == 0))
        ii, jj = [], []
        for d in range(1, FEW):
            i = few[few + d < len(group)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            near = _alike(fp, n, i, i + d, like)
            ii.append(i[near])
            jj.append(i[near] + d)
        for g in np.flatnonzero((sizes > FEW) | (sizes > 1) & (tile[cut[:-1]] != 0)):
            at = np.arange(cut[g], cut[g + 1])
            left, right = at[side[at] == 0], at[side[at] == 1]
            if side[at].max() == 1:
                pairs = [(left, right)]
            else:
                pairs = [(at[x : x + CHUNK], at[y : y + CHUNK]) for x in range(0, len(at), CHUNK) for y in range(x, len(at), CHUNK)]
            for a, b in pairs:
                i, j = _near(fp, n, a, b, like)
                ii.append(i)
                jj.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ii, jj))
        root = _roots(len(group), i, j)
        some = np.flatnonzero(root != np.arange(len(group)))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], ["u", "v"])

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(count)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]) and (held[0][0], held[1][0]) != (held[0][-1], held[1][-1]):
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1] + 1
            yield out([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held and len(held[0]):
        yield out(held)


class _Sets:
    """Documents with their sets and both fingerprints."""

    def __init__(self, sets: list[bytes], sketches: list[bytes]):
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        both = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, 2 * WORDS)
        self.simhash, self.parity = both[:, :WORDS], both[:, WORDS:]

    def alike(self, i: int, j: int, like: float) -> bool:
        n, m = int(self.n[i]), int(self.n[j])
        if min(n, m) < like * max(n, m) - 1e-9:
            return False
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return both >= like * (n + m - both) - 1e-9

    def near(self, left: np.ndarray, right: np.ndarray, like: float) -> Iterator[tuple[int, int]]:
        """Pairs of left and right that may be similar."""
        reach = longest_partner(LONG, like)
        for fp, a, b in ((self.simhash, left[self.n[left] >= LONG], right[self.n[right] >= LONG]), (self.parity, left[self.n[left] <= reach], right[self.n[right] <= reach])):
            i, j = _near(fp, self.n, a, b, like)
            yield from zip(i.tolist(), j.tolist(), strict=True)


class _Union:
    def __init__(self, n: int):
        self.label = list(range(n))

    def find(self, x: int) -> int:
        while self.label[x] != x:
            self.label[x] = self.label[self.label[x]]
            x = self.label[x]
        return x

    def join(self, x: int, y: int) -> None:
        p, q = self.find(x), self.find(y)
        self.label[max(p, q)] = min(p, q)


def _sketched(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingle_digests(raw, k) for raw in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([keys_of(d).tobytes() for d in own], pa.binary()), pa.array([simhash(d).tobytes() + parity(d).tobytes() for d in own], pa.binary()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "shingles", "fp", "key"])


def _exact(like: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the documents of each tile whose sets are as similar as asked. Rows
    of one label are known to be connected."""
    now, rows = None, []

    def out() -> pa.RecordBatch:
        side, labels, ids, sets, fps = zip(*rows, strict=True)
        own, side, at, one = _Sets(list(sets), list(fps)), np.array(side), np.arange(len(rows)), _Union(len(rows))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            if x is not None:
                one.join(i, first.setdefault(x, i))
        known = [one.find(i) for i in range(len(rows))]
        left, right = (at[side == 0], at[side == 1]) if side.max() else (at, at)
        for x, y in own.near(left, right, like):
            # What is connected already needs no comparison.
            if one.find(x) != one.find(y) and own.alike(x, y, like):
                one.join(x, y)
        root = [one.find(x) for x in range(len(rows))]
        some = [i for i in range(len(rows)) if root[i] != known[i]]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([ids[root[i]] for i in some], pa.int64())], ["u", "v"])

    for batch in batches:
        for key, tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (key, tile):
                if len(rows) > 1:
                    yield out()
                now, rows = (key, tile), []
            rows.append(row)
    if len(rows) > 1:
        yield out()


class _KeyPivots:
    """Labels fingerprints by the first pivot that may be similar, with pivots that may
    be similar to one another taken for one."""

    def __init__(self, pivots: pa.Table, like: float):
        self.like, self.ids = like, pivots.column("doc_id").to_pylist()
        self.fp, self.n = self._read(pivots)
        m = len(self.ids)
        self.one = _Union(m)
        for a in range(m):
            b = np.arange(a + 1, m)
            for y in b[_alike(self.fp, self.n, np.full(len(b), a), b, like)].tolist():
                self.one.join(a, y)

    @staticmethod
    def _read(rows) -> tuple[np.ndarray, np.ndarray]:
        words = [rows.column(f"f{i}").to_numpy() for i in range(WORDS)]
        return np.stack(words, axis=1).view(np.uint64), rows.column("n").to_numpy().astype(np.int64)

    def labels(self, rows: pa.Table) -> list[int | None]:
        own, n = self._read(rows)
        m, at = len(self.ids), np.arange(len(n))
        fp, n, found = np.concatenate([self.fp, own]), np.r_[self.n, n], np.full(len(at), m)
        for a in reversed(range(m)):
            found[_alike(fp, n, np.full(len(at), a), m + at, self.like)] = self.one.find(a)
        return [self.ids[a] if a < m else None for a in found.tolist()]


class _SetPivots:
    """Labels sets by the first pivot that is similar, with pivots similar to one another
    taken for one."""

    def __init__(self, pivots: pa.Table, like: float):
        self.like, self.ids = like, pivots.column("doc_id").to_pylist()
        self.raw = pivots.column("shingles").to_pylist(), pivots.column("fp").to_pylist()
        own, m = _Sets(*self.raw), len(self.ids)
        self.one = _Union(m)
        for a, b in own.near(np.arange(m), np.arange(m), like):
            if self.one.find(a) != self.one.find(b) and own.alike(a, b, like):
                self.one.join(a, b)

    def labels(self, rows: pa.Table) -> list[int | None]:
        m = len(self.ids)
        own = _Sets(self.raw[0] + rows.column("shingles").to_pylist(), self.raw[1] + rows.column("fp").to_pylist())
        found: list[int | None] = [None] * rows.num_rows
        for a, b in own.near(np.arange(m), m + np.arange(rows.num_rows), self.like):
            if found[b - m] is None and own.alike(a, b, self.like):
                found[b - m] = self.ids[self.one.find(a)]
        return found


def _labels(kind: type, like: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``label`` to rows that come sorted by key and salt, pivots first."""
    now, held, judge = None, [], None
    for batch in batches:
        names = [x for x in batch.schema.names if x not in ("salt", "member")]
        key, salt, member = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "salt", "member"))
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (member[1:] != member[:-1]), True]) if len(key) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if now != (key[a], salt[a]):
                now, held, judge = (key[a], salt[a]), [], None
            rows = pa.Table.from_batches([batch.slice(a, b - a)]).select(names)
            if not member[a]:
                held.append(rows)
                continue
            if judge is None:
                judge = kind(pa.concat_tables(held) if held else rows.slice(0, 0), like)
            yield from rows.append_column("label", pa.array(judge.labels(rows), pa.int64())).combine_chunks().to_batches()


def _labelled(rows: DataFrame, sizes: DataFrame, kind: type, like: float) -> DataFrame:
    """Large groups of ``rows`` (key, doc_id ...) with ``label``: about PIVOTS rows of
    each group, whatever its size, are what all its rows are compared with. Groups are
    dealt to tasks in salted parts, each with its own copy of the pivots."""
    sized = rows.join(small(sizes), "key").withColumn("parts", F.ceil(F.col("size") / CHUNK).cast("int"))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("size") / PIVOTS)) == 0
    pivots = sized.where(chosen).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("member", F.lit(False))
    members = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("parts")).cast("int")).withColumn("member", F.lit(True))
    both = pivots.unionByName(members).select(*rows.columns, "salt", "member").repartition("key", "salt").sortWithinPartitions("key", "salt", "member", "doc_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return stored(both.mapInArrow(partial(_labels, kind, like), kinds + ", label long"), "labelled")


def size_class(n: Column, like: float) -> Column:
    """Number of the class of a set of n: sets whose sizes allow the similarity are in
    one class or in neighbouring ones. Classes are a little wider than that needs, so
    that rounding parts none."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(1.0001 * math.log(1 / like))).cast("int")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, doc_id, label, class ...) with ``tile`` and ``side``, once for each
    tile a row is in: groups by key, label and size class are cut into chunks of about
    ``most``, and a tile is a pair of chunks of the same or neighbouring classes that are
    not of one label. A group whose rows share a label is in no tile; the tiles grow with
    the pairs still in question."""
    group = ["key", "class", "_l", "_n"]
    keyed = rows.withColumn("_l", F.coalesce(F.col("label"), F.lit(0))).withColumn("_n", F.col("label").isNull())
    sizes = stored(keyed.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("int").alias("k")), "sizes")
    chunks = sizes.select(*group, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    chunks = chunks.withColumn("i", F.row_number().over(W.Window.partitionBy("key").orderBy("class", "_n", "_l", "c")))
    chunks = stored(chunks.withColumn("all", F.count("*").over(W.Window.partitionBy("key"))), "chunks")
    # By class, so that chunks of one class and the next meet.
    a = chunks.select("key", F.col("i").alias("a"), "all", "_l", "_n", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("class").alias("own"))
    b = chunks.select("key", F.col("i").alias("b"), F.col("_l").alias("l"), F.col("_n").alias("n"), "class")
    pairs = a.join(b, ["key", "class"]).where("(own < class OR a <= b) AND (_n OR n OR _l <> l)")
    side = lambda i, x: F.struct(F.col(i).alias("i"), F.lit(x).alias("side"))
    both = F.when(F.col("a") == F.col("b"), F.array(side("a", 0))).otherwise(F.array(side("a", 0), side("b", 1)))
    pairs = pairs.select("key", F.explode(both).alias("x"), (F.col("a").cast("long") * (F.col("all") + 1) + F.col("b")).alias("tile"))
    pairs = stored(pairs.select("key", "x.i", "x.side", "tile"), "tiles")
    placed = keyed.join(small(sizes), group).withColumn("c", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("k")).cast("int"))
    return placed.join(small(chunks.drop("all")), [*group, "c"]).drop("_l", "_n", "class", "c", "k").join(small(pairs), ["key", "i"]).drop("i")


def _compared(rows: Callable[[DataFrame | None, str], DataFrame], sizes: DataFrame, most: int, kind: type, n: Column, like: float) -> tuple[DataFrame, DataFrame | None]:
    """(rows with tile, side and label; edges that labels stand for). ``rows`` gives the
    rows whose key is in a table (left_semi) or is not (left_anti); ``sizes`` are the
    large groups (key, size), above which a group isn't one tile."""

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(0)).withColumn("label", F.lit(None).cast("long"))

    if not sizes.count():
        return whole(rows(None, "")), None
    hot = _labelled(rows(small(sizes.select("key")), "left_semi"), sizes, kind, like)
    rest = whole(rows(small(sizes.select("key")), "left_anti"))
    hot_tiles = _dealt(hot.withColumn("class", size_class(n, like)), most)
    linked = hot.where("label IS NOT NULL AND label <> doc_id").select(F.col("doc_id").alias("u"), F.col("label").alias("v")).distinct()
    return rest.unionByName(hot_tiles), linked


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "side")


def frequent_shingles(own: DataFrame, k: int) -> Frequent:
    """(sorted names, counts) of the shingles that are frequent in a sample of the
    documents; at most RANKED of them, whatever the input."""
    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLE)) == 0).select("data")
    found = sample.mapInArrow(partial(_all_keys, k), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "key").limit(RANKED).collect()
    names, counts = np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def similar_components(docs: DataFrame, k: int = 5, like: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents of ``docs`` (doc_id, text) that have a
    near-duplicate: equal texts, or a share of ``like`` of k-word shingles (as sets)
    in common; component_id is the smallest doc_id reachable.

    Equal texts are grouped before shingles are made. Rare shingles, by counts in a
    sample, come first in the order; that changes the work and no result. Groups that
    meet by one shingle, and candidate groups before sets are compared, are compared
    with a few of their own rows first when they are large, and what that connects is
    not compared again; the rest meets in tiles. Rows without a doc_id are left out;
    rows of one doc_id are one document that has the links of all its texts; texts
    without words are only equal to the same text; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    own = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    digests_ = stored(own.select("doc_id", F.md5("data").alias("m")), "digests")
    # The join's key is another than the aggregate's, so that a large group of copies can be split.
    same = digests_.groupBy("m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.reverse("m").alias("r"), "first")
    copies = stored(digests_.withColumn("r", F.reverse("m")).join(same, "r").where("doc_id > first").select("doc_id", "m", "first"), "copies")
    rest = own.withColumn("m", F.md5("data")).join(small(copies.select("doc_id", "m")), ["doc_id", "m"], "left_anti").select("doc_id", "data")
    met = stored(rest.mapInArrow(partial(_meetings, k, like, frequent_shingles(own, k)), "key long, " + ", ".join(f"f{i} long" for i in range(WORDS)) + ", n int, doc_id long"), "meetings")
    often = met.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(SAMPLE)) == 0).groupBy("key").agg((F.count("*") * SAMPLE).alias("size")).where(F.col("size") > CHUNK)
    often = stored(often, "often")
    rows, linked = _compared(lambda keys, how: met if keys is None else met.join(keys, "key", how), often, CHUNK, _KeyPivots, F.col("n"), like)
    dealt = _sorted(rows.select("key", "tile", "side", "n", "doc_id", *(f"f{i}" for i in range(WORDS))))
    links = dealt.mapInArrow(partial(_candidates, like), "u long, v long")
    links = stored((links.union(linked) if linked is not None else links).distinct(), "candidates")
    forget(met, often)
    groups = stored(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("key")), "groups")
    large = stored(groups.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TILE), "large")

    def sets(keys: DataFrame | None, how: str) -> DataFrame:
        members = groups if keys is None else groups.join(keys, "key", how)
        return rest.join(small(members), "doc_id").select("doc_id", "data", "key").mapInArrow(partial(_sketched, k), "doc_id long, shingles binary, fp binary, key long")

    rows, linked = _compared(sets, large, TILE, _SetPivots, F.octet_length("shingles") / 8, like)
    proven = _sorted(rows.select("key", "tile", "side", "label", "doc_id", "shingles", "fp")).mapInArrow(partial(_exact, like), "u long, v long")
    proven = stored(proven.union(linked) if linked is not None else proven, "proven")
    forget(links, groups, large)
    found = connected_components(proven.union(copies.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))))
    forget(digests_, copies, proven)
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, like: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest
    doc_id, null last. Where ids repeat or are null, rows are numbered first (the
    numbers are written down with the rows), so that each row is judged by its own
    text: an unlike row of the same id stays, and a row repeated whole goes. Texts
    without words are alike only if equal; an empty table gives no rows; columns of
    any name pass through.
    """
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        found = similar_components(docs, k, like)
        gone = stored(found.where("doc_id <> component_id").select("doc_id"), "near-copies")
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = stored(docs.select(packed(docs.columns), F.monotonically_increasing_id().alias("_n")), "numbered")
    found = similar_components(rows.select(F.col("_n").alias("doc_id"), F.col("_row.text").alias("text")), k, like)
    members = found.join(rows.select(F.col("_n").alias("doc_id"), F.col("_row.doc_id").alias("own")), "doc_id")
    members = stored(members.select("doc_id", "component_id", F.struct(F.col("own").isNull().alias("no"), "own", "doc_id").alias("rank")), "members")
    first = members.groupBy("component_id").agg(F.min("rank").alias("least")).select(F.bitwise_not("component_id").alias("_key"), "least")
    gone = stored(members.withColumn("_key", F.bitwise_not("component_id")).join(first, "_key").where("rank <> least").select(F.col("doc_id").alias("_n")), "near-copies")
    forget(members)
    return rows.join(small(gone), "_n", "left_anti").select(*unpacked(docs.columns))
