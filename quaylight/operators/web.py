"""Links, titles and addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    """WEB1: link targets in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def meta_description(html: Column) -> Column:
    """WEB3: the last description meta (or og:description); null without."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<meta[^>]*(?:name|property)="(?:og: ?)?description"[^>]*content="([^"]*)"'), F.lit(1))
    return F.get(F.reverse(found), F.lit(0))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def canonical(url: Column) -> Column:
    """WEB5: scheme http, host with www., no slash at the end."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"/+$", "")
    return F.concat(F.lit("http://"), F.when(rest.startswith("www."), rest).otherwise(F.concat(F.lit("www."), rest)))


def domain(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]*)", 1)


def resolve(base: Column, link: Column) -> Column:
    """WEB2: absolute, rooted or relative link as an address."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))


def marked_link(pages: DataFrame, marker: str) -> DataFrame:
    """WEB2: of a page's links that hold a marker word the shortest, resolved."""
    found = pages.select("page_id", "url", F.explode(links(F.col("html"))).alias("link")).where(F.lower("link").contains(marker))
    full = found.select("page_id", resolve(F.col("url"), F.lower("link")).alias("link"))
    return full.groupBy("page_id").agg(F.min_by("link", F.struct(F.length("link"), F.col("link"))).alias("link"))


def followed(pages: DataFrame, markers: list[str], deny: tuple[str, ...] = ("pdf", "jpg", "png", "zip")) -> DataFrame:
    """WEB6: links a crawler of a site follows: same domain, a marker in the address,
    no denied extension."""
    found = pages.select("page_id", "url", F.explode(F.array_distinct(links(F.col("html")))).alias("link"))
    full = found.withColumn("target", resolve(F.col("url"), F.lower("link")))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.lower("link").contains(m)
    return full.where(marked & (domain(F.col("target")) == domain(F.col("url"))) & ~F.lower("link").rlike(rf"\.({'|'.join(deny)})$"))


def description_by_shortest_url(df: DataFrame, key: str) -> DataFrame:
    """AGG27: the first non-empty description by the shortest address."""
    return df.where(F.length("description") > 0).groupBy(key).agg(F.min_by("description", F.struct(F.length("url"), F.col("url"))).alias("description"))
