"""Boxes on pages and tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("y0", "x0", "y1", "x1")


def iou(a: str, b: str) -> Column:
    """DOC1: intersection over union of boxes whose columns have these prefixes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    area = lambda p: (F.col(f"{p}y1") - F.col(f"{p}y0")) * (F.col(f"{p}x1") - F.col(f"{p}x0"))
    inter = side("y0", "y1") * side("x0", "x1")
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def overlapping(boxes: DataFrame, page: str, box: str, cell: float) -> DataFrame:
    """DOC1: pairs of boxes of a page that overlap, lower id first. Boxes meet in the
    cells of a grid that they cover, so only neighbours are compared; ``cell`` should
    be about a box's size."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
    dealt = boxes.withColumn("_cy", F.explode(span("y0", "y1"))).withColumn("_cx", F.explode(span("x0", "x1")))
    a = dealt.select(page, "_cy", "_cx", F.col(box).alias("a"), *(F.col(c).alias(f"a_{c}") for c in BOX))
    b = dealt.select(page, "_cy", "_cx", F.col(box).alias("b"), *(F.col(c).alias(f"b_{c}") for c in BOX))
    pairs = a.join(b, [page, "_cy", "_cx"]).where(F.col("a") < F.col("b")).drop("_cy", "_cx").distinct()
    return pairs.withColumn("iou", F.round(iou("a_", "b_"), 6)).where("iou > 0").select(page, "a", "b", "iou")


def most_overlapped(pairs: DataFrame, page: str) -> DataFrame:
    """DOC3: each box's worst partner."""
    both = pairs.select(page, "a", "b", "iou").union(pairs.select(page, F.col("b"), F.col("a"), "iou"))
    return both.groupBy(page, F.col("a").alias("box")).agg(F.max("iou").alias("iou"), F.min_by("b", F.struct(-F.col("iou"), F.col("b"))).alias("partner"))


def cells(grids: DataFrame, table: str, rows: str, cols: str) -> DataFrame:
    """DOC4: the cells between the boundaries of a table's rows and columns."""
    pairs = lambda c: F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("lo"), F.slice(c, 2, F.size(c) - 1).alias("hi"))
    ok = grids.where((F.size(rows) > 1) & (F.size(cols) > 1))
    r = ok.select(table, cols, F.posexplode(pairs(F.col(rows))).alias("row", "_r"))
    return r.select(table, "row", F.col("_r.lo").alias("y0"), F.col("_r.hi").alias("y1"), F.posexplode(pairs(F.col(cols))).alias("col", "_c")).select(table, "row", "col", "y0", F.col("_c.lo").alias("x0"), "y1", F.col("_c.hi").alias("x1"))


def in_crop(boxes: DataFrame, crop: tuple[float, float, float, float]) -> DataFrame:
    """DOC6: boxes within a crop box (y0, x0, y1, x1 from below) scaled to it, y
    turned to run down; boxes outside or without area are dropped."""
    cy0, cx0, cy1, cx1 = crop
    ok = (F.col("y0") >= cy0) & (F.col("x0") >= cx0) & (F.col("y1") <= cy1) & (F.col("x1") <= cx1) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
    h, w = cy1 - cy0, cx1 - cx0
    own = boxes.where(ok)
    return own.select(*(c for c in boxes.columns if c not in BOX), ((cy1 - F.col("y1")) / h).alias("y0"), ((F.col("x0") - cx0) / w).alias("x0"), ((cy1 - F.col("y0")) / h).alias("y1"), ((F.col("x1") - cx0) / w).alias("x1"))


def _apart(pdf: pd.DataFrame) -> pd.DataFrame:
    """Boxes in falling confidence; each gives way to those before it by the least
    shift of an edge (rows before columns), and goes if nothing of it is left."""
    kept: list[np.ndarray] = []
    rows = []
    for r in pdf.sort_values(["confidence", "box_id"], ascending=[False, True]).itertuples():
        box = np.array([r.y0, r.x0, r.y1, r.x1], float)
        for other in kept:
            lo, hi = np.maximum(box[:2], other[:2]), np.minimum(box[2:], other[2:])
            if (hi <= lo).any():
                continue
            # Cuts that end the overlap: (cost, axis, edge, value).
            ways = [(other[a + 2] - box[a], a, a, other[a + 2]) for a in (0, 1)] + [(box[a + 2] - other[a], a, a + 2, other[a]) for a in (0, 1)]
            _, _, edge, value = min(ways, key=lambda w: (w[0], w[1]))
            box[edge] = value
            if (box[2:] <= box[:2]).any():
                break
        if (box[2:] > box[:2]).all():
            kept.append(box)
            rows.append((r.page_id, r.box_id, *box, r.confidence))
    return pd.DataFrame(rows, columns=["page_id", "box_id", *BOX, "confidence"])


def back_off(boxes: DataFrame) -> DataFrame:
    """DOC2: boxes of each page cut until none overlap, the surer ones first. The
    steps depend on one another, so a page is one group; pages have few boxes."""
    return boxes.groupBy("page_id").applyInPandas(_apart, "page_id long, box_id long, y0 double, x0 double, y1 double, x1 double, confidence double")


def boundaries(heat: np.ndarray, pad: float = 0.02, distance: int = 3) -> list[float]:
    """DOC5: row or column boundaries of a heat-map: padded by a share, clipped at
    Otsu's threshold, its peaks at least ``distance`` apart, and the two edges."""
    heat = np.asarray(heat, float)
    n = len(heat)
    if n == 0 or not heat.max() > heat.min():
        return [0.0, 1.0]
    margin = round(n * pad)
    values = np.sort(heat)
    w = np.arange(1, n)
    left, total = np.cumsum(values)[:-1], values.sum()
    between = w * (n - w) * (left / w - (total - left) / (n - w)) ** 2
    cut = values[int(between.argmax())]
    clipped = np.where(heat > cut, heat, 0)
    padded = np.r_[np.zeros(margin + 1), clipped, np.zeros(margin + 1)]
    peaks = [i - margin - 1 for i in range(1, len(padded) - 1) if padded[i] > 0 and padded[i] >= padded[i - 1] and padded[i] > padded[i + 1]]
    kept: list[int] = []
    for p in sorted(peaks, key=lambda p: (-clipped[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return [0.0, *sorted((p + 0.5) / n for p in kept), 1.0]


def grid_of(df: DataFrame) -> DataFrame:
    """DOC5: (table_id, rows, cols) boundaries from (table_id, row_hm, col_hm)."""

    def each(batches):
        for b in batches:
            yield pd.DataFrame({"table_id": b.table_id, "rows": [boundaries(x) for x in b.row_hm], "cols": [boundaries(x) for x in b.col_hm]})

    return df.select("table_id", "row_hm", "col_hm").mapInPandas(each, "table_id long, rows array<double>, cols array<double>")
