"""Benchmark decontamination with SimHash windows.

Every window of a document with as many words as a benchmark item gets a SimHash
fingerprint from running sums of bit votes; multi-index Hamming blocks over the
items of that length give all items whose fingerprints are within the radius, and
the weighted similarity of the shingles, counted with repeats, decides. The radius
loses no match (``sketch``): the n-th occurrence of a shingle is hashed as a shingle
of its own, so that weighted similarity is one of sets. A window as similar as asked
has most of its shingles among those of the benchmark, so windows that have too few
are passed over before they are fingerprinted.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, row_texts, table, unpacked, with_text
from .sketch import LONG, WORDS, digests, pack, parity, parity_radius, simhash, simhash_radius, votes

SHINGLE = 5
LIKE = 0.8
#: Blocks of 64 bits in a fingerprint: at the radius of long items one in sixty unrelated
#: pairs has a block as near as a pair within the radius must have; of 8 bits nearly all have.
BLOCKS = WORDS
#: Windows and items that are compared at a time.
WINDOW_TILE, ITEM_TILE = 2048, 512
#: Windows of a stretch of text.
STRETCH = 8192
#: Items and bytes of items compared in one pass over the documents; more of them
#: make more passes.
ITEMS, ITEM_BYTES = 20_000, 32 << 20

_word = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits: case and marks don't count."""
    return _word.findall(text.lower())


def shingles(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser weights over the sum of the greater."""
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


def occurrences(parts: list[str]) -> list[bytes]:
    """Names of shingles in which repeats differ: the n-th occurrence has its number."""
    seen: Counter = Counter()
    out = []
    for x in parts:
        own = x.encode("utf-8", "surrogatepass")
        out.append(own if not seen[x] else own + b"\0%d" % seen[x])
        seen[x] += 1
    return out


class Lengths:
    """Items of one length with the index of their fingerprints."""

    def __init__(self, n_words: int, size: int, like: float):
        self.n_words, self.size, self.shingles = n_words, size, n_words - size + 1
        self.like, self.items, self.bags = like, [], []
        self._simhash, self._parity = [], []

    def add(self, item: int, parts: list[str]) -> None:
        d = digests(occurrences(parts))
        self.items.append(item)
        self.bags.append(Counter(parts))
        self._simhash.append(simhash(d))
        self._parity.append(parity(d))

    def done(self) -> None:
        self.simhash, self.parity = np.array(self._simhash), np.array(self._parity)

    def by_simhash(self, window: int) -> bool:
        return min(window, self.shingles) >= LONG

    def within(self, fps: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, windows) whose fingerprints are in the radius. Within radius r some of the
        blocks differ in r // BLOCKS bits at most: only pairs with such a block can be. Windows
        and items meet in tiles, so memory doesn't grow with the items."""
        own, radius = (self.simhash, simhash_radius(self.like)) if self.by_simhash(window) else (self.parity, int(parity_radius(window + self.shingles, self.like)))
        for first in range(0, len(own), ITEM_TILE):
            some = own[first : first + ITEM_TILE]
            near = np.zeros((len(fps), len(some)), bool)
            for at in range(0, len(fps), WINDOW_TILE):
                tile = fps[at : at + WINDOW_TILE]
                met, apart = np.zeros((len(tile), len(some)), bool), np.zeros((len(tile), len(some)), np.uint16)
                for k in range(BLOCKS):
                    bits = np.bitwise_count(tile[:, k][:, None] ^ some[:, k][None, :])
                    met |= bits <= radius // BLOCKS
                    apart += bits
                near[at : at + WINDOW_TILE] = met & (apart <= radius)
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                yield first + j, np.flatnonzero(near[:, j])


class Run:
    """Shingles of a stretch of a text, for exact counts of what windows share with items."""

    def __init__(self, parts: list[str], window: int):
        self.window, self.n = window, len(parts) - window + 1
        self.codes: dict[str, int] = {}
        code = np.fromiter((self.codes.setdefault(x, len(self.codes)) for x in parts), np.int64, len(parts))
        # places of each shingle, one shingle after the other
        self.places = np.argsort(code, kind="stable")
        self.starts = np.append(0, np.bincount(code, minlength=len(self.codes)).cumsum())

    def shared(self, bag: Counter) -> np.ndarray:
        """Shingles, with repeats, that each window shares with an item. One at place p counts
        in a window if the window has fewer of it before p than the item has in all: in the
        windows that begin after the place of that many occurrences before."""
        own = [(self.codes[x], n) for x, n in bag.items() if x in self.codes]
        if not own:
            return np.zeros(self.n, np.int64)
        code, times = np.array(own, np.int64).T
        first, many = self.starts[code], self.starts[code + 1] - self.starts[code]
        first, times = first.repeat(many), times.repeat(many)
        at = first + np.arange(len(first)) - (many.cumsum() - many).repeat(many)
        p = self.places[at]
        before = np.where(at - times >= first, self.places[np.maximum(at - times, 0)], -1)
        low, high = np.minimum(np.maximum(before + 1, np.maximum(p - self.window + 1, 0)), self.n), np.minimum(p + 1, self.n)
        real = low < high
        return (np.bincount(low[real], minlength=self.n + 1) - np.bincount(high[real], minlength=self.n + 1)).cumsum()[: self.n]


def window_fingerprints(parts: list[str], starts: np.ndarray, window: int, by_simhash: bool) -> np.ndarray:
    """(n, 4) words of the windows of ``window`` shingles at ``starts`` in ``parts``,
    from running sums; windows that repeat a shingle are made one by one."""
    last: dict[str, int] = {}
    before = np.empty(len(parts), np.int64)
    for i, x in enumerate(parts):
        before[i] = last.get(x, -1)
        last[x] = i
    d = digests([x.encode("utf-8", "surrogatepass") for x in parts])
    bits = votes(d) if by_simhash else (d[:, :1] == np.arange(256, dtype=np.uint8)[None, :]).astype(np.uint8)
    sums = np.zeros((len(parts) + 1, bits.shape[1]), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    own = sums[starts + window] - sums[starts]
    out = pack(2 * own > window if by_simhash else (own & 1).astype(np.uint8))
    if (before >= 0).any():
        latest = np.lib.stride_tricks.sliding_window_view(before, window).max(axis=1)[starts]
        for i in np.flatnonzero(latest >= starts).tolist():
            one = digests(occurrences(parts[starts[i] : starts[i] + window]))
            out[i] = simhash(one) if by_simhash else parity(one)
    return out


def _stretches(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of neighbouring windows, none longer than STRETCH."""
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        for at in range(0, len(run), STRETCH):
            yield run[at : at + STRETCH]


class Items:
    """Benchmark items by length, with the shingles that any of them has."""

    def __init__(self, rows: list[tuple[int, str]], k: int = SHINGLE, like: float = LIKE):
        self.k, self.like, self.vocabulary = k, like, {}
        lengths: dict[int, Lengths] = {}
        grams: dict[int, set[int]] = defaultdict(set)
        for item, text in rows:
            own = words_of(text or "")
            if not own:
                continue
            size = min(k, len(own))
            lengths.setdefault(len(own), Lengths(len(own), size, like)).add(item, shingles(own, size))
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], np.int64)
            grams[size].update(self._keys(codes, size)[0].tolist())
        for x in lengths.values():
            x.done()
        self.grams = {size: (np.array(sorted(x), np.uint64), sorted((y for y in lengths.values() if y.size == size), key=lambda y: y.n_words)) for size, x in grams.items()}

    @staticmethod
    def _keys(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the runs of ``size`` words, all known, and where they start."""
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.r_[0, np.cumsum(codes < 0)]
        at = np.flatnonzero(known[size:] == known[:-size])
        keys = np.zeros(len(at), np.uint64)
        for i in range(size):
            keys = (keys ^ (codes[at + i].astype(np.uint64) + np.uint64(1))) * _P
            keys ^= keys >> np.uint64(29)
        return keys, at

    def _starts(self, x: Lengths, hits: np.ndarray, window: int, n: int) -> np.ndarray:
        """Windows with enough shingles of the benchmark to be as similar as asked."""
        least = self.like * (x.shingles + window) / (1 + self.like) - 1e-9
        if len(hits) < least:
            return hits[:0]
        # Hits to and from which a window may have enough.
        few = max(1, int(np.ceil(least)))
        close = np.flatnonzero(hits[few - 1 :] - hits[: len(hits) - few + 1] < window)
        if not len(close):
            return hits[:0]
        low, high = np.maximum(hits[close + few - 1] - window + 1, 0), np.minimum(hits[close], n - window)
        some = np.zeros(n - window + 2, np.int64)
        np.add.at(some, low[low <= high], 1)
        np.add.at(some, high[low <= high] + 1, -1)
        return np.flatnonzero(np.cumsum(some)[: n - window + 1] > 0)

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item
        that is as similar as asked; of equal ones the first."""
        words = words_of(text)
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for size, (known, lengths) in self.grams.items():
            keys, at = self._keys(codes, size)
            if not len(keys):
                continue
            hits = at[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
            if not len(hits):
                continue
            n = len(words) - size + 1
            for x in lengths:
                window = min(x.shingles, n)
                starts = self._starts(x, hits, window, n)
                best: dict[int, tuple[float, int]] = {}
                for run in _stretches(starts):
                    low = int(run[0])
                    parts = shingles(words[low : int(run[-1]) + window + size - 1], size)
                    fps = window_fingerprints(parts, run - low, window, x.by_simhash(window))
                    counts = None
                    for i, at_windows in x.within(fps, window):
                        counts = counts or Run(parts, window)
                        begin = run[at_windows] - low
                        same = counts.shared(x.bags[i])[begin]
                        likes = same / (x.shingles + window - same)
                        top = int(likes.argmax())
                        if likes[top] >= self.like - 1e-12 and likes[top] > best.get(i, (0.0, 0))[0]:
                            best[i] = (float(likes[top]), low + int(begin[top]))
                out += [(x.items[i], like, start, window + size - 1) for i, (like, start) in sorted(best.items())]
        return out


def _search(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    for b in batches:
        out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in items.matches(t or "")]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])


def _clean(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([not items.matches(t or "") for t in row_texts(b)], pa.bool_()))


def item_blocks(benchmark: DataFrame, k: int, like: float) -> Iterator[Items]:
    """The items in blocks of bounded number and bytes, whatever the benchmark's size."""
    own = benchmark.where("text IS NOT NULL").select("item_id", "text")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    for i in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else own
        yield Items([(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()], k, like)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, like: float = LIKE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every document row and
    item with a window at least ``like`` similar.

    Items are sent to the executors in blocks of bounded size, one pass each. Null and
    wordless texts and items match nothing; an item shorter than a shingle is one
    shingle, so that an item of one word matches every text with that word; a document
    shorter than an item is one window; repeated rows, of either table, each have their
    matches; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, k, like):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(partial(_search, items), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` without a match, row by row: rows of one doc_id are judged
    each by its own text. Columns of any name pass through."""
    arrow_batches(docs.sparkSession)
    rows = with_text(docs, docs.columns)
    for items in item_blocks(benchmark, k, like):
        rows = rows.mapInArrow(partial(_clean, items), rows.schema)
    return rows.select(*unpacked(docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
