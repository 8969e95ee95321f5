"""Removal of repeated byte strings over the whole corpus.

Every string of SPAN bytes that also starts in a document with a smaller id is
found exactly, in three steps that never ship the text of all positions:

1. Anchors. Of the SPAN - GRAM + 1 grams in a string of SPAN bytes the least by
   hash is its anchor, so equal strings have equal anchors at the same offset. An
   anchor stands for the run of strings it is least in, about 18 of them.
2. Whole runs. Anchors meet by gram. A run whose bytes equal those of a run in an
   earlier document is repeated whole: most repeats end here.
3. Suffix order. What is left, the edges of repeats, meets with its bytes. In each
   task the suffixes at these strings are sorted blockwise, one bucket of leading
   bytes at a time, and long ties are resolved by ranks of a difference-cover
   sample made beforehand: neighbours with SPAN bytes in common are equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_batches, small, stored, table

SPAN = 50
GRAM = 16
#: Bytes left or right of the gram that strings of one side must share.
SIDE = (SPAN - GRAM) // 2
#: Period and differences of the cover: any two residues reach it by one shift.
PERIOD, COVER = 7, (0, 1, 3)
#: Rows of a gram in a task, about, and one document in how many is looked at to find the
#: grams that have more. Both change the work, not the result.
HOT, SAMPLE = 1 << 18, 64
#: Positions of a suffix bucket sorted at a time.
BUCKET = 1 << 19
#: Bytes of text looked at together.
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M = np.uint64(0xD6E8FEB86659FD93)


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, PIECE + SPAN), _powers(_PINV, PIECE + SPAN)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number, first byte leading."""
    x = b.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] << np.uint64(8 * s) | x[s:]
    return x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.pad(x, (0, -len(x) % w), constant_values=np.uint64(2**64 - 1)).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, gram key, run key, sums) of the strings that start at
    ``starts``, a mask; of equal hashes the last counts. At most PIECE starts."""
    x = _eights(b)
    h = _mix(x[: len(x) - 8] * _P + _mix(x[8:]))
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 21) - 1)
    least = _sliding_min(h & ~low | (low - at), SPAN - GRAM + 1)
    anchor = (low - (least & low)).astype(np.int64)
    p = np.flatnonzero(starts[: len(anchor)])
    a = anchor[p]
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * _UP[: len(b)])]
    if not len(p):
        return a, p, p, h[:0], h[:0], sums
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    first, last, a = p[cut], p[np.r_[cut[1:] - 1, len(p) - 1]], a[cut]
    run = (sums[last + SPAN] - sums[first]) * _DOWN[first]
    run = _mix(run ^ _mix(((a - first) * 64 + last - first).astype(np.uint64)))
    return a, first, last, h[a], run, sums


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(bytes, mask of string starts, (text, offset in it, place) of the parts):
    short texts together, long ones in parts that overlap."""
    held, room = [], 0

    def out():
        b = np.frombuffer(b"".join(texts[i][o : o + n] for i, o, n in held), np.uint8)
        starts, placed, at = np.zeros(len(b), bool), [], 0
        for i, o, n in held:
            starts[at : at + max(0, n - SPAN + 1)] = True
            placed.append((i, o, at))
            at += n
        return b, starts, placed

    for i, t in enumerate(texts):
        o = 0
        while len(t) - o >= SPAN:
            n = min(len(t) - o, PIECE)
            if held and room + n > PIECE:
                yield out()
                held, room = [], 0
            held.append((i, o, n))
            room += n
            if o + n == len(t):
                break
            o += n - SPAN + 1
    if held:
        yield out()


def _owners(placed: list[tuple[int, int, int]], first: np.ndarray) -> np.ndarray:
    """Index into ``placed`` of each run."""
    return np.searchsorted(np.array([x[2] for x in placed]), first, side="right") - 1


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for b, starts, placed in _pieces(batch.column(1).to_pylist()):
            _, first, _, gram, run, _ = _anchors(b, starts)
            doc = ids[np.array([x[0] for x in placed])[_owners(placed, first)]]
            rows = np.stack([doc.view(np.uint64), run, gram])
            # A document counts once for a run that it repeats.
            rows = rows[:, np.argsort(rows[1] ^ rows[0] * _P)]
            keep = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)] if rows.shape[1] else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(r[keep].view(np.int64)) for r in rows], ["doc", "run", "gram"])


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for, once for each side of the gram."""
    names = ["key", "doc", "run", "lead", "data"]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        asked = [np.array(x, np.int64).view(np.uint64) for x in batch.column(2).to_pylist()]
        for b, starts, placed in _pieces(texts):
            a, first, last, _, run, sums = _anchors(b, starts)
            which, data, out = _owners(placed, first), b.tobytes(), []
            for k in range(len(placed)):
                own = np.flatnonzero(which == k)
                doc = placed[k][0]
                own = own[np.isin(run[own], asked[doc])]
                # With as much left of the gram as SIDE and more; with less.
                for side, lo, hi, s in ((1, first[own], np.minimum(last[own], a[own] - SIDE - 1), a[own] - SIDE), (2, np.maximum(first[own], a[own] - SIDE), last[own], a[own])):
                    some = lo <= hi
                    e = s[some] + SIDE + GRAM
                    keys = _mix((sums[e] - sums[s[some]]) * _DOWN[s[some]] + np.uint64(side)).view(np.int64)
                    out += [(key, ids[doc], r, i - x, data[x : y + SPAN]) for key, r, i, x, y in zip(keys.tolist(), run[own][some].view(np.int64).tolist(), a[own][some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def cover_ranks(x8: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the sample positions (residue in COVER) of n bytes by at least SPAN
    bytes; elsewhere 0. Sample positions are a period apart, so each doubling looks
    up a rank that the sample has."""
    rank = np.zeros(n + SPAN + 2 * PERIOD, np.int64)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    keys, length = (x8[at] >> np.uint64(8)), PERIOD
    rank[at] = np.unique(keys, return_inverse=True)[1] + 1
    while length < SPAN:
        far = rank[np.minimum(at + length, n)]
        keys = rank[at] * (int(rank.max()) + 1) + far
        rank[at] = np.unique(keys, return_inverse=True)[1] + 1
        length *= 2
    return rank


def equal_strings(text: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of positions ``at``, bucket by bucket in suffix order: (order, group), where
    group numbers runs of equal SPAN bytes. Equal strings must be at places equal
    modulo PERIOD, which the caller arranges; then one shift to the cover serves a
    whole tie."""
    n = len(text)
    x8 = _eights(np.r_[text, np.zeros(2 * SPAN, np.uint8)])
    rank = cover_ranks(x8, n)
    shift = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
    lead = x8[at]
    # Buckets: ranges of the leading bytes with a bounded number of positions.
    top = np.sort(lead >> np.uint64(32))
    edges = np.unique(np.r_[0, top[BUCKET::BUCKET], 2**32].astype(np.uint64))
    place = np.searchsorted(edges, lead >> np.uint64(32), side="right")
    for b in range(1, len(edges)):
        own = np.flatnonzero(place == b) if len(edges) > 2 else np.arange(len(at))
        if not len(own):
            continue
        p = at[own]
        res = p % PERIOD
        order = np.lexsort((rank[np.minimum(p + shift[res], n)], res, lead[own]))
        p = p[order]
        same = np.ones(len(p) - 1, bool)
        for k in (0, 8, 16, 24, 32, 40, SPAN - 8):
            same &= x8[p[1:] + k] == x8[p[:-1] + k]
        yield own[order], np.r_[0, np.cumsum(~same)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come sorted by key, so all that may be equal is in one run of rows."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        docs, lead = t.column("doc").to_numpy(), t.column("lead").to_numpy()
        data = t.column("data").to_pylist()
        size = np.array([len(x) for x in data])
        # Grams begin at places that are 0 modulo the period.
        pad = (-lead) % PERIOD
        begin = np.r_[0, np.cumsum((pad + size + PERIOD - 1) // PERIOD * PERIOD)]
        text = np.zeros(begin[-1], np.uint8)
        for s, q, x in zip(begin.tolist(), pad.tolist(), data, strict=False):
            text[s + q : s + q + len(x)] = np.frombuffer(x, np.uint8)
        n = size - SPAN + 1
        row = np.repeat(np.arange(len(data)), n)
        nth = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        at = begin[row] + pad[row] + nth
        bits = np.uint64(1) << (lead[row] - nth).astype(np.uint64)
        mask = np.zeros(len(data), np.uint64)
        for own, group in equal_strings(text, at):
            least = np.full(int(group[-1]) + 1, 2**63 - 1, np.int64)
            np.minimum.at(least, group, docs[row[own]])
            later = own[docs[row[own]] > least[group]]
            np.bitwise_or.at(mask, row[later], bits[later])
        some = np.flatnonzero(mask)
        cols = [t.column(c).to_numpy()[some] for c in ("doc", "run")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, mask[some].view(np.int64))], ["doc", "run", "mask"])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < 20_000 or held[0].column(0)[0] == b.column(0)[-1]:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield out(t.slice(0, last))
        held = t.slice(last).to_batches()
        rows = t.num_rows - last
    if rows:
        yield out(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    whole = np.uint64(2**64 - 1)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        flags = []
        for runs, masks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keys = np.array(runs or [], np.int64).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            uniq, start = np.unique(keys[order], return_index=True)
            own = np.array(masks or [], np.int64).view(np.uint64)[order]
            flags.append((uniq, np.bitwise_or.reduceat(own, start) if len(uniq) else own))
        cover = [np.zeros(len(t) + 1, np.int32) if len(f[0]) else None for t, f in zip(texts, flags, strict=True)]
        for b, starts, placed in _pieces([t if c is not None else b"" for t, c in zip(texts, cover, strict=True)]):
            a, first, last, _, run, _ = _anchors(b, starts)
            which = _owners(placed, first)
            for k, (doc, offset, place) in enumerate(placed):
                own = np.flatnonzero(which == k)
                uniq, masks = flags[doc]
                j = np.minimum(np.searchsorted(uniq, run[own]), len(uniq) - 1)
                own, j = own[uniq[j] == run[own]], j[uniq[j] == run[own]]
                c, shift = cover[doc], offset - place
                full = masks[j] == whole
                np.add.at(c, first[own[full]] + shift, 1)
                np.add.at(c, last[own[full]] + SPAN + shift, -1)
                for i, m in zip(own[~full].tolist(), masks[j[~full]].tolist(), strict=True):
                    for p in range(int(first[i]), int(last[i]) + 1):
                        if m >> (int(a[i]) - p) & 1:
                            c[p + shift] += 1
                            c[p + SPAN + shift] -= 1
        out = []
        for d, t, c in zip(batch.column(0).to_pylist(), texts, cover, strict=True):
            if c is None:
                out.append((d, len(t), 0, 0, hashlib.sha256(t).hexdigest(), []))
                continue
            gone = np.cumsum(c[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            out.append((d, len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _frequent_grams(rows: DataFrame) -> DataFrame | None:
    """(gram, parts) of the grams that stand in over HOT rows by a sample of documents."""
    sample = rows.where(F.pmod(F.xxhash64("doc", F.lit(17)), F.lit(SAMPLE)) == 0).mapInArrow(_emit_anchors, "doc long, run long, gram long")
    found = sample.groupBy("gram").agg(F.ceil(F.count("*") * SAMPLE / HOT).cast("int").alias("parts")).where("parts > 1")
    found = stored(found, "hot")
    return found if found.count() else None


def _met(anchors: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(doc, run, first) of the runs whose gram an earlier or later document has too, with
    the first document that has the run; runs alone of their gram and run are left out
    where they can't matter. The rows of a frequent gram are dealt to parts, and what the
    parts found is put together by minima, so that no gram is one task's."""
    if hot is None:
        keyed = anchors.withColumn("part", F.lit(None).cast("int"))
    else:
        keyed = anchors.join(small(hot), "gram", "left").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(19)), F.col("parts")).cast("int"))
    by = ["gram"] if hot is None else ["gram", "part"]
    by_run, by_gram = W.Window.partitionBy(*by, "run"), W.Window.partitionBy(*by)
    seen = keyed.withColumn("first", F.min("doc").over(by_run))
    seen = seen.withColumn("shared", F.min("doc").over(by_gram) < F.max("doc").over(by_gram)).withColumn("many", F.min("run").over(by_gram) < F.max("run").over(by_gram))
    matters = F.col("shared") & (F.col("many") | (F.col("first") < F.col("doc")))
    if hot is None:
        return stored(seen.where(matters).select("doc", "run", "first"), "anchors")
    found = stored(seen.where(matters | F.col("part").isNotNull()).select("doc", "run", "first", F.when(F.col("part").isNotNull(), F.col("gram")).alias("gram")), "anchors")
    often = found.where("gram IS NOT NULL")
    runs = stored(often.groupBy("gram", "run").agg(F.min("first").alias("least"), F.min("doc").alias("low"), F.max("doc").alias("high")), "runs")
    grams = runs.groupBy("gram").agg((F.min("low") < F.max("high")).alias("shared"), (F.min("run") < F.max("run")).alias("many"))
    known = stored(runs.join(small(stored(grams, "grams")), "gram").select("gram", "run", "least", "shared", "many"), "known")
    kept = often.join(small(known), ["gram", "run"]).where(F.col("shared") & (F.col("many") | (F.col("least") < F.col("doc"))))
    return found.where("gram IS NULL").select("doc", "run", "first").unionByName(stored(kept.select("doc", "run", F.col("least").alias("first")), "frequent"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of
    ``docs`` (doc_id, text); ``spans`` lists the bounds of the bytes removed.

    Null texts are empty, texts under SPAN bytes are kept whole, strings never
    cross texts. Rows with one doc_id are not earlier than one another; a null
    doc_id is later than any other. Run keys have 64 bits beside the gram's 64, and
    edges are compared byte by byte. The texts are shuffled once, by doc_id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow_batches(spark)
    last_id = F.lit(2**63 - 1)
    rows = docs.select(F.coalesce("doc_id", last_id).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    anchors = rows.mapInArrow(_emit_anchors, "doc long, run long, gram long")
    met = _met(anchors, _frequent_grams(rows))
    texts = rows.repartition(parts, "doc")
    edges = met.where(F.col("first") == F.col("doc")).groupBy("doc").agg(F.collect_set("run").alias("runs"))
    contexts = texts.join(edges.hint("shuffle_hash"), "doc").select("doc", "data", "runs").mapInArrow(_emit_contexts, "key long, doc long, run long, lead int, data binary")
    partly = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "doc long, run long, mask long")
    whole = met.where(F.col("first") < F.col("doc")).select("doc", "run", F.lit(-1).cast("long").alias("mask"))
    flags = whole.unionByName(partly).groupBy("doc").agg(F.collect_list(F.struct("run", "mask")).alias("f"))
    flags = flags.select("doc", F.col("f.run").alias("runs"), F.col("f.mask").alias("masks"))
    out = texts.join(flags.hint("shuffle_hash"), "doc", "left").select("doc", "data", "runs", "masks").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < last_id, F.col("doc_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
