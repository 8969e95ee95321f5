"""Web pages and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geometry as G
from ..operators import web as WB
from ..sources.io import table
from .registry import query

_links = """SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages"""


@query("page_links", f"SELECT page_id, link, count(*) AS n FROM ({_links}) GROUP BY 1, 2")
def page_links(spark, sf):
    """WEB1"""
    return table(spark, sf, "pages").select("page_id", F.explode(WB.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("page_title_text", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \n\t\r]+', ' ', 'g'))) AS text_md5 FROM pages".replace('\\"', '"'))
def page_title_text(spark, sf):
    """WEB3 WEB4 WEB7: title and the digest of the text by patterns."""
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", WB.title(h).alias("title"), F.md5(X.unfold_lines(X.fold_lines(X.html_text(h))).cast("binary")).alias("text_md5"))


_rest = "regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '/+$', '')"


@query("url_canon", f"SELECT page_id, 'http://' || CASE WHEN {_rest} LIKE 'www.%' THEN {_rest} ELSE 'www.' || {_rest} END AS url FROM pages")
def url_canon(spark, sf):
    """WEB5"""
    return table(spark, sf, "pages").select("page_id", WB.canonical(F.col("url")).alias("url"))


@query("domain_counts", "SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark, sf):
    """WEB5 SRC16"""
    return table(spark, sf, "pages").groupBy(WB.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_full = f"SELECT page_id, url, link, CASE WHEN regexp_matches(lower(link), '^[a-z]+://') THEN lower(link) WHEN lower(link) LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || lower(link) ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || lower(link) END AS target FROM ({_links})"


@query("marked_link", f"SELECT page_id, arg_min(target, (length(target), target)) AS link FROM ({_full}) WHERE lower(link) LIKE '%an%' GROUP BY 1")
def marked_link(spark, sf):
    """WEB2"""
    return WB.marked_link(table(spark, sf, "pages"), "an")


@query("followed_links", f"SELECT DISTINCT page_id, link, target FROM ({_full}) WHERE (lower(link) LIKE '%an%' OR lower(link) LIKE '%er%') AND regexp_extract(lower(target), '^[a-z]+://([^/?#:]*)', 1) = regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AND NOT regexp_matches(lower(link), '\\.(pdf|jpg|png|zip)$')")
def followed_links(spark, sf):
    """WEB6"""
    return WB.followed(table(spark, sf, "pages"), ["an", "er"]).select("page_id", "link", "target")


@query("shortest_page", "WITH d AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS site, url, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS t FROM pages) SELECT site, arg_min(t, (length(url), url)) AS description FROM d WHERE length(t) > 0 GROUP BY 1")
def shortest_page(spark, sf):
    """AGG27: each site's title by its shortest address."""
    p = table(spark, sf, "pages").select(WB.domain(F.col("url")).alias("site"), "url", WB.title(F.col("html")).alias("description"))
    return WB.description_by_shortest_url(p, "site")


#: Parts as boxes: a page of a hundred, placed by size and price.
_boxes = "SELECT p_partkey // 100 AS page, p_partkey AS box, (p_size * 10)::DOUBLE AS y0, (p_partkey % 100 * 8)::DOUBLE AS x0, (p_size * 10 + 30)::DOUBLE AS y1, (p_partkey % 100 * 8 + 20)::DOUBLE AS x1 FROM part"


def boxes(spark, sf):
    p = table(spark, sf, "part")
    x = F.col("p_partkey") % 100 * 8
    return p.select(F.floor(F.col("p_partkey") / 100).alias("page"), F.col("p_partkey").alias("box"), (F.col("p_size") * 10).cast("double").alias("y0"), x.cast("double").alias("x0"), (F.col("p_size") * 10 + 30).cast("double").alias("y1"), (x + 20).cast("double").alias("x1"))


_iou = f"WITH b AS ({_boxes}), p AS (SELECT a.page, a.box AS a, b.box AS b, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS i FROM b a JOIN b ON a.page = b.page AND a.box < b.box) SELECT page, a, b, round(i / (1200 - i), 6) AS iou FROM p WHERE i > 0"


@query("iou_pairs", _iou)
def iou_pairs(spark, sf):
    """DOC1"""
    return G.overlapping(boxes(spark, sf), "page", "box", 32.0)


@query("most_overlapped", f"WITH p AS ({_iou}), u AS (SELECT page, a AS box, b AS other, iou FROM p UNION ALL SELECT page, b, a, iou FROM p) SELECT page, box, max(iou) AS iou, arg_min(other, (-iou, other)) AS partner FROM u GROUP BY 1, 2")
def most_overlapped(spark, sf):
    """DOC3"""
    return G.most_overlapped(G.overlapping(boxes(spark, sf), "page", "box", 32.0), "page")


@query("grid_cells", "WITH g AS (SELECT s_suppkey AS t, [0.0, 10.0 + s_suppkey, 30.0 + s_suppkey]::DOUBLE[] AS r, [0.0, 5.0, 9.0, 20.0 + s_nationkey]::DOUBLE[] AS c FROM supplier) SELECT t, (i - 1)::INTEGER AS row, (j - 1)::INTEGER AS col, r[i] AS y0, c[j] AS x0, r[i + 1] AS y1, c[j + 1] AS x1 FROM g, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2, 3]) AS j)")
def grid_cells(spark, sf):
    """DOC4"""
    s = table(spark, sf, "supplier")
    d = lambda *x: F.array(*(F.lit(v).cast("double") if not hasattr(v, "cast") else v.cast("double") for v in x))
    g = s.select(F.col("s_suppkey").alias("t"), d(0.0, F.col("s_suppkey") + 10, F.col("s_suppkey") + 30).alias("r"), d(0.0, 5.0, 9.0, F.col("s_nationkey") + 20).alias("c"))
    return G.cells(g, "t", "r", "c")


@query("cropped_boxes", f"WITH b AS ({_boxes}) SELECT page, box, round((400 - y1) / 300, 6) AS y0, round((x0 - 100) / 500, 6) AS x0, round((400 - y0) / 300, 6) AS y1, round((x1 - 100) / 500, 6) AS x1 FROM b WHERE y0 >= 100 AND y1 <= 400 AND x0 >= 100 AND x1 <= 600")
def cropped_boxes(spark, sf):
    """DOC6"""
    out = G.in_crop(boxes(spark, sf), (100.0, 100.0, 400.0, 600.0))
    return out.select("page", "box", *(F.round(c, 6).alias(c) for c in G.BOX))


@query("backed_off_boxes")
def backed_off_boxes(spark, sf):
    """DOC2"""
    b = boxes(spark, sf).select(F.col("page").alias("page_id"), F.col("box").alias("box_id"), *G.BOX, (F.col("box") % 97 / 97.0).alias("confidence"))
    return G.back_off(b)


@query("heatmap_grid")
def heatmap_grid(spark, sf):
    """DOC5: boundaries from the vectors read as heat-maps."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("table_id"), F.col("embedding").cast("array<double>").alias("row_hm"), F.reverse(F.col("embedding").cast("array<double>")).alias("col_hm"))
    return G.grid_of(e)
