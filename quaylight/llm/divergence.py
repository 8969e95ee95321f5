"""Source divergence audit: how far the sources of a language are apart in their terms.

Most distinct terms of a corpus are rare, and terms that too few documents hold don't
count. A first pass therefore adds document frequencies to a count-min sketch: a task
has one, its counters stop at the frequency that is asked for, and the sketches are
merged piece by piece. A counter is never below the frequency of a term that falls on
it, so what all rows of the sketch place below the bound is impossible, and a second
pass leaves it out before anything is shuffled. What is left is counted exactly.

Shares of two sources are then compared through joins of the counts that exist: terms
that only one of two sources has are taken from the histogram of its counts, terms that
neither has are one number, and only terms of both meet in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, forget, stored, table

#: Bytes of terms: letters, and all of UTF-8 that isn't ASCII.
OF_TERM = np.array([chr(c).isalpha() or c > 0x7F for c in range(256)])
#: Bytes with A-Z in lower case.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Rows of the sketch; a term is kept if all of them allow it.
ROWS = 3
#: A row has a counter for so many bytes of text, within these bounds: at most 96 MB in
#: a task that counts, and 12 MB of bits in one that looks up.
BYTES_A_COUNTER, LEAST, MOST = 64, 1 << 16, 1 << 25
#: Counters that are merged at a time.
PIECE = 1 << 16
#: Shares are billionths.
WHOLE = 1_000_000_000


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of all terms of a text column without nulls, in order."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = OF_TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # a text begins anew also where the one before ends in a term
    first = ends[:-1][ends[:-1] < len(raw)]
    begins[first] = inside[first]
    places = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(LOWER[raw[inside]]))
    return np.searchsorted(ends[1:], np.flatnonzero(begins), "right"), words


class Counts:
    """Terms of a batch by group: ``group`` and ``word`` number the pairs that occur,
    ``n`` is how often, ``docs`` in how many rows."""

    def __init__(self, groups: list[tuple], texts: pa.Array):
        rows, words = terms(texts)
        coded = words.dictionary_encode()
        self.words, self.groups = coded.dictionary, list(dict.fromkeys(groups))
        known = {g: i for i, g in enumerate(self.groups)}
        group = np.fromiter((known[g] for g in groups), np.int64, len(groups))
        many, n = max(1, len(self.words)), len(groups)
        key = np.sort(((group[rows] * many) + coded.indices.to_numpy(zero_copy_only=False)) * n + rows)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times, pair = np.diff(np.append(new, len(key))), key[new] // n
        own = np.flatnonzero(np.diff(pair, prepend=-1))
        self.n = np.add.reduceat(times, own) if len(own) else times
        self.docs = np.diff(np.append(own, len(pair)))
        self.group, self.word = pair[own] // many, pair[own] % many

    def spots(self, lang: int, width: int) -> np.ndarray:
        """(ROWS, pairs) counters on which the pairs' languages and terms fall; ``lang`` is
        the place of the language in a group."""
        langs, words = _hashes([g[lang] for g in self.groups])[self.group], _hashes(self.words.to_pylist())[self.word]
        h = (langs ^ words) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        shift = np.uint64(64 - width.bit_length() + 1)
        return np.stack([((h[:, 0] + np.uint64(r) * (h[:, 1] | np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift for r in range(ROWS)]).astype(np.int64)


def _hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _add(sketch: np.ndarray, rows: np.ndarray, n: np.ndarray, bound: int) -> None:
    for r in range(ROWS):
        at, back = np.unique(rows[r], return_inverse=True)
        sketch[r, at] = np.minimum(bound, sketch[r, at] + np.bincount(back, weights=n)).astype(sketch.dtype)


def _sketch(width: int, bound: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sketch of (lang, text) rows, in compressed pieces that aren't empty."""
    sketch = None
    for b in batches:
        if b.num_rows:
            sketch = np.zeros((ROWS, width), np.min_scalar_type(bound)) if sketch is None else sketch
            found = Counts(list(zip(b.column(0).to_pylist(), strict=True)), b.column(1))
            _add(sketch, found.spots(0, width), found.docs, bound)
    if sketch is not None:
        pieces = sketch.reshape(-1, min(PIECE, width))
        at = [i for i, p in enumerate(pieces) if p.any()]
        for i in at:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(pieces[i].tobytes(), 1)], pa.binary())], ["piece", "counts"])


def _merge(bound: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds pieces that come in order of their number; a bit says whether a counter reached the bound."""
    last, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(total >= bound).tobytes()], pa.binary())], ["piece", "reached"])

    for b in batches:
        for piece, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(raw), np.min_scalar_type(bound))
            if piece != last:
                if last is not None:
                    yield out()
                last, total = piece, np.zeros(len(counts), np.int64)
            total = np.minimum(bound, total + counts)
    if last is not None:
        yield out()


class Sketch:
    """Which counters reached ``bound``: pairs that have another on them are in fewer documents."""

    def __init__(self, width: int, pieces: dict[int, bytes]):
        each = min(PIECE, width) // 8
        self.width = width
        self.bits = np.frombuffer(b"".join(pieces.get(i, bytes(each)) for i in range(ROWS * width // (8 * each))), np.uint8).reshape(ROWS, -1)

    def possible(self, at: np.ndarray) -> np.ndarray:
        """Of pairs at these counters."""
        out = np.ones(at.shape[1], bool)
        for bits, own in zip(self.bits, at, strict=True):
            out &= (bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1 == 1
        return out


def width_for(size: int) -> int:
    """Counters of a sketch row for so many bytes of text, a power of two."""
    return min(MOST, max(LEAST, 1 << (size // BYTES_A_COUNTER).bit_length()))


def sketch(docs: DataFrame, lang: str, text: str, bound: int, width: int) -> Sketch:
    """The merged sketch of document frequencies."""
    parts = docs.select(lang, text).mapInArrow(partial(_sketch, width, bound), "piece int, counts binary")
    pieces = ROWS * width // min(PIECE, width)
    merged = parts.repartition(min(pieces, 200), "piece").sortWithinPartitions("piece").mapInArrow(partial(_merge, bound), "piece int, reached binary")
    return Sketch(width, {r.piece: bytes(r.reached) for r in merged.collect()})


def _survivors(found, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of a batch, without impossible terms."""
    for b in batches:
        if b.num_rows:
            own = Counts(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(2))
            keep = np.flatnonzero(found.value.possible(own.spots(0, found.value.width)))
            names = [pa.array([g[i] for g in own.groups], pa.string()).take(pa.array(own.group[keep])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, own.words.take(pa.array(own.word[keep])), pa.array(own.n[keep]), pa.array(own.docs[keep])], ["lang", "source", "term", "count", "docs"])


def counted(docs: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count) of the terms that ``bound`` documents of a language or
    more hold, and (lang, source) of all documents; both stored."""
    spark = docs.sparkSession
    arrow_batches(spark)
    plain = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("_text"))
    groups = stored(plain.groupBy("lang", "source").agg(F.sum(F.octet_length("_text")).alias("size")), "groups")
    size = groups.agg(F.sum("size")).first()[0] or 0
    known = spark.sparkContext.broadcast(sketch(plain, "lang", "_text", bound, width_for(size)))
    found = plain.mapInArrow(partial(_survivors, known), "lang string, source string, term string, count long, docs long")
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    often = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= bound).select("lang", "term")
    kept = stored(counts.join(often, ["lang", "term"]).select("lang", "source", "term", "count"), "kept")
    forget(counts)
    return kept, groups.select("lang", "source")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * kinds)), exact; null if there is nothing to share."""
    whole = F.lit(WHOLE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    parts = F.nullif(total + 2 * kinds, F.lit(0)).cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", whole, parts)


def apart(p: Column, q: Column) -> Column:
    """floor((p-q)^2 / (p+q)) of shares up to WHOLE + 1, exact."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, bound: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) over all documents.

    Each language keeps the terms that ``bound`` of its documents hold. Part ``pair`` gives
    for each source all other sources of its language, the furthest first; part ``term``
    the ``top`` terms in which it is most above its language. Null text, lang and source
    are as empty; a repeated row is a document of its own, whatever its doc_id; sources
    without a term have the share of unseen terms everywhere; a language without kept terms
    gives distances of 0 and no terms; no documents give no rows. Other columns are not read.
    """
    kept, groups = counted(docs, bound)
    kinds = kept.groupBy("lang").agg(F.countDistinct("term").alias("kinds"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sources = (
        groups.join(kinds, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("unseen", share(F.lit(0), F.col("total"), F.col("kinds")))
    )
    sources = stored(sources, "sources")
    shares = stored(kept.join(sources, ["lang", "source"]).select("lang", "source", "term", "count", "unseen", share(F.col("count"), F.col("total"), F.col("kinds")).alias("p")), "shares")

    one, two = (sources.select("lang", F.col("source").alias(name), F.col("unseen").alias(f"{name}_unseen"), F.col("kinds").alias("kinds")) for name in ("a", "b"))
    pairs = one.join(two.drop("kinds"), "lang").where("a < b")
    neither = apart(F.col("a_unseen"), F.col("b_unseen"))
    base = pairs.select("lang", "a", "b", (F.coalesce(neither, F.lit(0)) * F.col("kinds")).alias("value"))
    # terms of one source, as if the other had none of them: by distinct shares of it
    lone = shares.groupBy("lang", "source", "p", "unseen").agg(F.count("*").alias("n"))
    other = sources.select("lang", F.col("source").alias("other"), F.col("unseen").alias("other_unseen"))
    lone = lone.join(other, "lang").where("source <> other").select(
        "lang",
        F.least("source", "other").alias("a"),
        F.greatest("source", "other").alias("b"),
        (F.col("n") * (apart(F.col("p"), F.col("other_unseen")) - apart(F.col("unseen"), F.col("other_unseen")))).alias("value"),
    )
    # terms of both: what they are apart, in place of what was counted for them above
    x, y = (shares.select("lang", "term", *(F.col(c).alias(f"{name}_{c}") for c in ("source", "p", "unseen"))) for name in ("x", "y"))
    x_p, x_no, y_p, y_no = F.col("x_p"), F.col("x_unseen"), F.col("y_p"), F.col("y_unseen")
    both = x.join(y, ["lang", "term"]).where("x_source < y_source")
    both = both.select("lang", F.col("x_source").alias("a"), F.col("y_source").alias("b"), (apart(x_p, y_p) - apart(x_p, y_no) - apart(x_no, y_p) + apart(x_no, y_no)).alias("value"))
    distance = base.union(lone).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pair = distance.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    wide = shares.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    whole = sources.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds"))
    wide = wide.join(whole, "lang").select("lang", "term", share(F.col("count"), F.col("total"), F.col("kinds")).alias("q"))
    term = shares.join(wide, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pair.select("*", order).union(term.select("*", order).where(F.col("rank") <= top))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = """
    WITH d AS (
        SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
        FROM documents
    ), t AS (
        SELECT i, lang, source, unnest(words) AS term FROM d
    ), kept AS (
        SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10
    ), v AS (
        SELECT g.lang, g.source, coalesce(k.kinds, 0) AS kinds
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, count(*) AS kinds FROM kept GROUP BY lang) k ON g.lang = k.lang
    ), c AS (
        SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL
    ), dense AS (
        SELECT v.lang, v.source, k.term, coalesce(c.n, 0) AS n, v.kinds
        FROM v JOIN kept k ON v.lang = k.lang LEFT JOIN c ON c.lang = v.lang AND c.source = v.source AND c.term = k.term
    ), p AS (
        SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * kinds) AS p FROM dense
    ), w AS (
        SELECT lang, term, sum(n) AS n, any_value(kinds) AS kinds FROM dense GROUP BY lang, term
    ), q AS (
        SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * kinds) AS q FROM w
    ), pair AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
        FROM v a JOIN v b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY a.lang, a.source, b.source
    ), term AS (
        SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value
        FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
    ), u AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM u QUALIFY part = 'pair' OR rank <= 10
"""
