"""Main text of web pages, with site templates removed.

Every element subtree is hashed, but the article and what it stands in are never
template; Spark counts on how many different pages of a host each hash occurs, and
subtrees that recur on many of them are deleted, with what is boilerplate by its
element, role or class. Subtrees within articles are counted apart from others, over
different articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, arrow_batches, stored, table

#: A subtree is template on a host if it is on so many pages and so large a share.
#: By the share a host has a bounded number of template subtrees.
LEAST_PAGES = 5
SHARE = 0.3

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROP = frozenset("aside audio button datalist dialog fieldset footer form head header input label menu meter nav option output progress video".split())
RAW = "script|style|noscript|template|svg|math|iframe|textarea|title|select|object|canvas|noframes|xmp"
# A start tag closes the open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
NOT_IN_P = frozenset("address article aside blockquote center details dialog dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul div".split())
SCOPE = frozenset("table ul ol dl article section main div body html".split())
# Words in a class, id or role that name what isn't the article.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Of these, names that parts of a story bear too: within an article they count only where
# most of the text is links, or where it holds something to press or to fill in.
WEAK = frozenset(
    "banner complementary dialog header masthead menu modal notice notices notification notifications popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social subscribe toolbar widget widgets".split()
)
# Words that such a name may be joined with; with any other (ad-hoc, share-price) it is another word.
WITH = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content desktop el entry fixed footer global google group head header holder icon icons id inline inner item items js layout left link links list lower main mobile module outer page pane panel placeholder post posts primary region right row secondary section site size slot small space sticky stories tags text title top unit upper user view wrap wrapper".split()
)
CONTROLS = frozenset("button form input".split())
# Cells of a table recur by their values; only whole rows and tables are template.
CELLS = frozenset("td th".split())
# What holds running text: an inline element in it is part of a sentence.
PROSE = frozenset("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_token = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S | re.I,
)
_named = re.compile(r"(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(20_000)
def _attributes(attrs: str) -> tuple[str, int, bool]:
    """(class and id, 2 if they name boilerplate, 1 if by weak names only, whether it is
    hidden)"""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _named.finditer(attrs)}
    own = f"{got.get('class', '')} {got.get('id', '')}"
    parts = set()
    for name in f"{own} {got.get('role', '')}".split():
        words = {p.lower() for p in _part.findall(name)}
        if words <= NAMES | WITH:
            parts |= words & NAMES
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.sub(r"\s", "", got.get("style", "")).lower().find("display:none") >= 0
    return own.strip(), 2 if parts & (NAMES - WEAK) else int(bool(parts & WEAK)), hidden


class Page:
    """Elements of a page in order: tag, attributes, parent, subtree hash, characters of
    text and of linked text, whether it holds controls, whether text stands directly in it, whether
    it holds or is within an article, and the events (element opened, None for closed, or text) they
    came in."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parents, self.hashes, self.main, self.inside, self.prose = [], [], [], [], [], [], []
        self.events: list[int | str | None] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.pressed: list[bool] = []
        self._stack: list[int] = []
        self._parts: list[list[str]] = []
        at = 0
        for m in _token.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if m[2] or m[5]:
                self._end(tag)
            else:
                self._start(tag, m[4] or "")
        if at < len(source):
            self._text(source[at:])
        while self._stack:
            self._close()

    def _text(self, text: str) -> None:
        self.events.append(text)
        if self._stack and (own := " ".join(text.split())):
            self._parts[-1].append(own)
            self.chars[self._stack[-1]] += len(own)
            self.prose[self._stack[-1]] = True

    def _start(self, tag: str, attrs: str) -> None:
        if tag in NOT_IN_P:
            self._until({"p"}, SCOPE)
        if tag in CLOSES:
            while self._until(CLOSES[tag], SCOPE if tag in ("li", "dt", "dd") else {"table"}):
                pass
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.hashes.append(0)
        self.main.append(False)
        self.prose.append(False)
        self.chars.append(0)
        self.linked.append(0)
        self.pressed.append(tag in CONTROLS)
        p = self.parents[i]
        self.inside.append(p >= 0 and (self.inside[p] or self.tags[p] in ("article", "main")))
        if tag in ("article", "main"):
            while p >= 0 and not self.main[p]:
                self.main[p] = True
                p = self.parents[p]
        self.events.append(i)
        self._stack.append(i)
        self._parts.append([])
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            self._close()

    def _close(self) -> None:
        i, parts = self._stack.pop(), self._parts.pop()
        self.events.append(None)
        own = self.hashes[i] = xxhash.xxh64_intdigest("\x00".join((self.tags[i], _attributes(self.attrs[i])[0], *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)
        if self.tags[i] == "a":
            self.linked[i] = self.chars[i]
        if self._parts:
            self._parts[-1].append(str(own))
            up = self._stack[-1]
            self.chars[up] += self.chars[i]
            self.linked[up] += self.linked[i]
            self.pressed[up] |= self.pressed[i]

    def _until(self, names, stop) -> bool:
        """Closes the nearest open element of these names, if none of ``stop`` is
        in between."""
        for depth in range(len(self._stack) - 1, -1, -1):
            tag = self.tags[self._stack[depth]]
            if tag in names:
                while len(self._stack) > depth:
                    self._close()
                return True
            if tag in stop:
                return False
        return False

    def _end(self, tag: str) -> None:
        self._until({tag}, {"article", "main", "body"} if tag not in ("article", "main", "body", "html") else ())

    def _may_recur(self, i: int) -> bool:
        """Whether an element may be template: not an article nor around one; within
        one, no cell and no part of a sentence."""
        tag = self.tags[i]
        if self.main[i] or tag in ("article", "main", "br", "html", "body", "head"):
            return False
        if not self.inside[i]:
            return True
        p = self.parents[i]
        return tag not in CELLS if tag in BLOCK else not self.prose[p] and self.tags[p] in BLOCK - PROSE

    def _key(self, i: int) -> int:
        """Subtree hash, another within articles than outside."""
        return ~self.hashes[i] if self.inside[i] else self.hashes[i]

    def templates(self) -> tuple[set[int], set[int]]:
        """Hashes of the subtrees that may be template, outside and within articles."""
        own: tuple[set[int], set[int]] = (set(), set())
        for i in range(len(self.tags)):
            if self._may_recur(i):
                own[self.inside[i]].add(self._key(i))
        return own

    def articles(self) -> list[int]:
        """Hashes of the outermost articles."""
        return [h for t, h, n in zip(self.tags, self.hashes, self.inside, strict=True) if t in ("article", "main") and not n]

    def _dropped(self, i: int, recurring) -> bool:
        tag, holds = self.tags[i], self.main[i]
        if holds and tag not in ("aside", "form", "nav", "footer"):
            return False
        if recurring and self._may_recur(i) and self._key(i) in recurring:
            return True
        if tag in HEADINGS and self.inside[i]:
            return False
        _, named, hidden = _attributes(self.attrs[i]) if self.attrs[i] else ("", 0, False)
        if named == 1 and self.inside[i] and 2 * self.linked[i] <= self.chars[i] and not self.pressed[i]:
            named = 0
        if tag == "header" and self.inside[i]:
            return hidden
        if tag in ("article", "main"):
            return hidden or bool(named) and tag == "article"
        return tag in DROP or bool(named) or hidden

    def _survivors(self, recurring) -> tuple[set[str], bool]:
        """Names (article, main) of the elements that are left, and whether the articles
        may be teasers or comments: several side by side, or each in what is named so."""
        n = len(self.tags)
        gone, doubt, under, left, outer = [False] * n, [False] * n, [False] * n, set(), []
        for i, (tag, p) in enumerate(zip(self.tags, self.parents, strict=True)):
            gone[i] = p >= 0 and gone[p] or self._dropped(i, recurring)
            doubt[i] = p >= 0 and doubt[p] or tag not in ("html", "body", "article", "main") and bool(self.attrs[i]) and _attributes(self.attrs[i])[1] > 0
            under[i] = p >= 0 and (under[p] or self.tags[p] == "article" and not gone[p])
            if tag in ("article", "main") and not gone[i]:
                left.add(tag)
                if tag == "article" and not under[i]:
                    outer.append(i)
        return left, len(outer) > 1 or all(doubt[i] for i in outer)

    def text(self, recurring=frozenset()) -> str:
        """Blocks of the articles, else of main, else of the body: of the first that has
        text when boilerplate is deleted. Articles that may be teasers or comments are
        passed over if main, or the body where there is none, has more text beside
        them."""
        if "article" not in self.tags and "main" not in self.tags:
            return self._blocks(None, recurring)
        left, doubtful = self._survivors(recurring)
        own = self._blocks("article", recurring) if "article" in left else ""
        if own and not doubtful:
            return own
        wide = "main" in left and self._blocks("main", recurring) or self._blocks(None, recurring)
        return wide if len(wide) > 2 * len(own) else own

    def _blocks(self, top: str | None, recurring) -> str:
        whole = top is not None
        blocks, now, open_, off, kept = [], [], [], 0, 0

        def end():
            if now:
                own = " ".join(html.unescape("".join(now)).split())
                if own:
                    blocks.append(own)
                now.clear()

        for e in self.events:
            if e is None:
                i, down = open_.pop()
                off -= down
                if self.tags[i] in BLOCK:
                    end()
                kept -= whole and self.tags[i] == top
            elif isinstance(e, str):
                if not off and (kept or not whole):
                    now.append(e)
            else:
                down = bool(off) or self._dropped(e, recurring)
                off += down
                open_.append((e, down))
                tag = self.tags[e]
                if tag in BLOCK:
                    end()
                elif tag == "br" and not off and (kept or not whole):
                    now.append(" ")
                kept += whole and tag == top
        end()
        return "\n".join(blocks)


def host(url: str | None = "url"):
    """Host of a URL, lower-case, without port and www; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of each page with the hash of its html, and those within articles with
    the hash of its articles; one of null stands for the page."""
    for b in batches:
        hosts, withins, hashes, contents = [], [], [], []
        for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            whole = (source or "", " ".join(map(str, page.articles())))
            for within, own in enumerate(page.templates()):
                if within and not whole[1]:
                    continue
                content = xxhash.xxh64_intdigest(whole[within].encode("utf-8", "surrogatepass")) - (1 << 63)
                hosts += [h] * (len(own) + 1)
                withins += [bool(within)] * (len(own) + 1)
                hashes += [None, *own]
                contents += [content] * (len(own) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(withins, pa.bool_()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], ["host", "within", "hash", "content"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [Page(s or "").text(frozenset(r or ())) for s, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    Subtree counts are made over all pages; pages without a host share one. Null
    and empty html has no text; a page of nothing but boilerplate neither. Copies
    of a page on a host (equal html) count as one page, within articles those of equal articles too. Only hosts of ``least_pages``
    different pages or more have templates. Every row has its own text, whatever its page_id; further columns are not read.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    own = pages.select("page_id", "url", "html", host().alias("host"))
    found = own.select("host", "html").mapInArrow(_subtrees, "host string, within boolean, hash long, content long").distinct().groupBy("host", "within", "hash").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least_pages))
    found = stored(found, "subtrees")
    n = found.where("hash IS NULL").select("host", "within", F.col("n").alias("pages"))
    found = found.where("hash IS NOT NULL").join(n, ["host", "within"]).where(F.col("n") >= F.col("pages") * share)
    known = stored(found.groupBy("host").agg(F.collect_list("hash").alias("recurring"), F.count("*").alias("n")), "templates")
    lists = known.select("host", "recurring")
    # Hashes are counted, not hosts: a list is as long as its host has templates.
    if (known.agg(F.sum("n")).first()[0] or 0) <= SMALL:
        lists = F.broadcast(lists)
    return own.join(lists, "host", "left").select("page_id", "url", "html", "recurring").mapInArrow(_texts, "page_id long, url string, text string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
