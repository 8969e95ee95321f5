"""Exact nearest neighbours of vectors and assignment to centres."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import numbers as N
from .relational import top_k
from .tiles import Best, matrices, rounded, tiled

#: Numbers of one gather of pairs whose scores are worked out exactly.
GATHERED = 1 << 22


def _exact(kind: str, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (a[i], b[j]) in double precision, added up in the order of the
    coordinates; null scores are left to the caller."""
    out, step = np.empty(len(i)), max(1, GATHERED // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        x, y = a[i[at : at + step]].T, b[j[at : at + step]].T
        total = lambda terms: sum(terms, np.zeros(x.shape[1]))  # noqa: B023, E731
        if kind == "l2":
            out[at : at + step] = -total((u - v) * (u - v) for u, v in zip(x, y, strict=True))
            continue
        s = total(u * v for u, v in zip(x, y, strict=True))
        out[at : at + step] = s / (np.sqrt(total(u * u for u in x)) * np.sqrt(total(v * v for v in y))) if kind == "cosine" else s
    return out


def _bounds(kind: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is above the score of each pair, by no more than what single
    precision can lose (double, where numbers are large)."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    top = max(na.max(initial=0), nb.max(initial=0))
    t = np.float32 if top < 1e15 else np.float64
    c = 4 * (a.shape[1] + 8) * np.finfo(t).eps
    if kind == "cosine":
        a, b, na, nb = a / na[:, None], b / nb[:, None], np.ones(len(a)), np.ones(len(b))
    if kind == "l2":
        x, y = [2 * a, -(1 - 2 * c) * na[:, None] ** 2, np.ones((len(a), 1))], [b, np.ones((len(b), 1)), -(1 - 2 * c) * nb[:, None] ** 2]
    else:
        x, y = [a, na[:, None]], [b, c * nb[:, None]]
    return np.hstack(x).astype(t), np.hstack(y).astype(t)


def _codes(q: pa.Table, r: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values; nulls equal nothing."""
    both = pa.chunked_array(q[name].chunks + r[name].chunks, q[name].type).combine_chunks()
    both = both if isinstance(both, pa.Array) else pa.concat_arrays(both.chunks)
    codes = pc.fill_null(pc.dictionary_encode(both).indices, -1).to_numpy(zero_copy_only=False)
    a, b = codes[: len(q)], codes[len(q) :]
    return a, np.where(b < 0, -2, b)


def _nearest(kind: str, k: int, tiers: int, schema: pa.Schema, q: pa.Table, r: pa.Table) -> pa.Table:
    qk, rk = q["query"].to_numpy(), r["_key"].to_numpy()
    qt, rt = zip(*(_codes(q, r, f"_t{i}") for i in range(tiers)), strict=True) if tiers else ((), ())
    best = Best(len(qk), k)
    parts = {d: (at, m) for d, at, m in matrices(r["_key"], r["_v"])}
    for d, qi, a in matrices(q["query"], q["_v"]):
        if d not in parts:
            continue
        ri, b = parts[d]
        if kind == "cosine":  # no score with a zero vector
            some = lambda m: np.sqrt((m * m).sum(1)) != 0
            qi, a, ri, b = qi[some(a)], a[some(a)], ri[some(b)], b[some(b)]
        order = np.argsort(rk[ri], kind="stable")
        ri, b = ri[order], b[order]
        with np.errstate(all="ignore"):
            x, y = _bounds(kind, a, b)
            start, size = 0, max(64, 2 * k)
            while start < len(ri):  # few rows first, which give the bounds for more
                own = slice(start, start + size)
                start, size = start + size, min(2 * size, 2048)
                last = best.last[qi]
                bound = x @ y[own].T
                need = np.where(np.isfinite(last), last - 1e-6 * (1 + np.abs(last)), last).astype(x.dtype)[:, None]
                good, level = ~(bound < need), np.zeros((1, 1), np.int8)
                if tiers:
                    level = np.full(bound.shape, tiers, np.int8)
                    for i in reversed(range(tiers)):
                        level[qt[i][qi][:, None] == rt[i][ri[own]][None, :]] = i
                    last = best.last_tier[qi][:, None]
                    good = (level < last) | ((level == last) & good)
                i, j = np.nonzero(good)
                differ = qk[qi[i]] != rk[ri[own]][j]
                i, j = i[differ], j[differ]
                s = _exact(kind, a, b[own], i, j)
                if kind == "cosine":  # underflow of a norm
                    i, j, s = (z[~np.isinf(s)] for z in (i, j, s))
                best.add(qi[i], np.broadcast_to(level, good.shape)[i, j].astype(np.int64), s, rk[ri[own][j]])
    if best.key is None:
        return schema.empty_table()
    return pa.Table.from_arrays([pa.array(z).cast(t) for z, t in zip((qk[best.q], best.key, best.tier, best.raw), schema.types, strict=True)], schema=schema)


def knn(queries: DataFrame, rows: DataFrame, key: str, array: str, k: int, kind: str = "l2", tiers: tuple[Column, ...] = ()) -> DataFrame:
    """VEC1-5, JN26, SRT8, SRT10: the k best rows for each query, itself left out, by
    inner product, negative squared distance or cosine; null scores never rank. A pair is of
    the tier of the first of ``tiers`` that is equal on both sides, else of the next number,
    and lower tiers come first, so a query is filled from wider groups only when the narrower
    have too few. Blocks of a stated query set meet parts of the rows: a matrix product
    bounds each score from above, those that may be among the k are worked out exactly, and
    a task keeps k a query before anything is shuffled."""
    own = [t.alias(f"_t{i}") for i, t in enumerate(tiers)]
    kind_of = rows.schema[key].dataType
    schema = pa.schema([("query", to_arrow_type(kind_of)), ("_key", to_arrow_type(kind_of)), ("tier", pa.int64()), ("_score", pa.float64())])
    q, r = queries.select(F.col(key).alias("query"), F.col(array).alias("_v"), *own), rows.select(F.col(key).alias("_key"), F.col(array).alias("_v"), *own)
    names = f"query {kind_of.simpleString()}, _key {kind_of.simpleString()}, tier long, _score double"
    near = tiled(q, r, "query", "_key", partial(_nearest, kind, k, len(tiers), schema), names)
    scored = near.select("query", F.col("_key").alias(key), "tier", F.round("_score", 6).alias("score"))
    return top_k(scored, ["query"], [F.asc("tier"), F.desc("score"), F.asc(key)], k)


def _tally(q: pa.Table, r: pa.Table) -> pa.Table:
    """(score, c, p) of all pairs of a block and a part."""
    qk, rk = q["query"].to_numpy(), r["_key"].to_numpy()
    ql, rl = _codes(q, r, "_t0")
    scores, counts = [], []
    parts = {d: (at, m) for d, at, m in matrices(r["_key"], r["_v"])}
    for d, qi, a in matrices(q["query"], q["_v"]):
        if d not in parts:
            continue
        ri, b = parts[d]
        for at in range(0, len(qi), 512):
            i = qi[at : at + 512]
            for to in range(0, len(ri), 8192):
                j = ri[to : to + 8192]
                with np.errstate(all="ignore"):
                    s = rounded((a[at : at + 512] @ b[to : to + 8192].T).ravel())
                other = (qk[i][:, None] != rk[j][None, :]).ravel()
                same = (ql[i][:, None] == rl[j][None, :]).ravel()
                s, same = s[other], same[other]
                low, high = (np.rint(s.min() * 1e6), np.rint(s.max() * 1e6)) if len(s) else (0, 0)
                if len(s) and high - low < 1 << 23:  # no sort where scores lie close (not so with a NaN)
                    at_ = np.rint(s * 1e6 - low).astype(np.int64)
                    n, p = np.bincount(at_), np.bincount(at_[same], minlength=int(high - low) + 1)
                    some = np.flatnonzero(n)
                    scores.append((some + low) / 1e6)
                    counts.append(np.stack([n[some], p[some]]))
                else:
                    u, at_ = np.unique(s, return_inverse=True)
                    scores.append(u)
                    counts.append(np.stack([np.bincount(at_, minlength=len(u)), np.bincount(at_[same], minlength=len(u))]))
                if len(scores) > 16:
                    scores, counts = _merged(scores, counts)
    schema = pa.schema([("score", pa.float64()), ("c", pa.int64()), ("p", pa.int64())])
    if not scores:
        return schema.empty_table()
    (u,), (n,) = _merged(scores, counts)
    return pa.Table.from_arrays([pa.array(u), pa.array(n[0]), pa.array(n[1])], schema=schema)


def _merged(scores: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n = np.concatenate(counts, axis=1)
    u, at = np.unique(np.concatenate(scores), return_inverse=True)
    total = np.zeros((2, len(u)), np.int64)
    for row, of in zip(total, n, strict=True):
        np.add.at(row, at, of)
    return [u], [total]


def inner_tally(queries: DataFrame, rows: DataFrame, key: str, array: str, label: str) -> DataFrame:
    """GRF3: (score, c, p): how many pairs of a stated query set and the rows, a query with
    itself left out, have each inner product to six places, and how many of these have equal
    labels. Pairs are counted in the tasks that make them."""
    of = lambda d, name: d.select(F.col(key).alias(name), F.col(array).alias("_v"), F.col(label).alias("_t0"))
    t = tiled(of(queries, "query"), of(rows, "_key"), "query", "_key", _tally, "score double, c long, p long")
    return t.groupBy("score").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))


def centres(rows: DataFrame, group: str, array: str) -> DataFrame:
    """AGG33: element-wise mean of the vectors of each group."""
    at = rows.select(group, F.posexplode(array).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))


def nearest_centres(rows: DataFrame, key: str, array: str, centres_: DataFrame, group: str, k: int = 2) -> DataFrame:
    """VEC15, VEC16: the k nearest centres of each vector. Centres are few and meet
    rows as one broadcast array."""
    all_ = centres_.agg(F.collect_list(F.struct(group, "centre")).alias("_all"))
    flat = rows.join(F.broadcast(all_)).select(key, F.col(array).alias("_v"), F.explode("_all").alias("c"))
    scored = flat.select(key, F.col(f"c.{group}").alias(group), F.round(N.squared_l2(F.col("_v"), F.col("c.centre")), 6).alias("d"))
    return top_k(scored, [key], [F.asc("d"), F.asc(group)], k)


def gap_loss(two: DataFrame, key: str) -> DataFrame:
    """VEC16: (b - a) / max(a, b) of the nearest and second-nearest centre."""
    a, b = F.max(F.when(F.col("rank") == 1, F.col("d"))), F.max(F.when(F.col("rank") == 2, F.col("d")))
    return two.groupBy(key).agg(F.round(F.try_divide(b - a, F.greatest(a, b)), 5).alias("gap"))


