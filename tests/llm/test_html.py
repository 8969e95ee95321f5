import random

import pytest

from quaylight.llm import html as H

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>m</nav><div id="cookie-notice">c</div><main><article><header><h1>T &amp; x</h1></header>
<p>a <i>b</i>c&nbsp; d<p>e<div class="ad">x</div><ul><li>1<li>2</ul><section class="comments"><article class="comment">cc</article></section><form>f</form></article></main><aside>z</aside><footer>q</footer>"""


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (PAGE, "T & x\na bc d\ne\n1\n2"),
        ("<div><p>one</p>two<script>a<b</script><b>x</b></div><table><tr><td>1<td>2<tr><td>3</table> a < b &lt;", "one\ntwox\n1\n2\n3\na < b <"),
        ("", ""), ("plain", "plain"), ("<article>a<br>b</article>", "a b"), ("<article><p>cut <a hre", "cut"), ("<!-- open <p>x", ""), ("<p hidden>x</p><p style='display: none'>y</p>z", "z"),
        ('<article><p title="a > b">x</p></article><div class="related">y</div>', "x"), ("<main><h1>t</h1>x</main><p>y", "t\nx"), ("<article>&#65;&#x42;&unknown;</article>", "AB&unknown;"),
    ],
)
def test_text(source, want):
    assert H.Page(source).text() == want


def test_templates_are_deleted_by_host(spark):
    banner = "<div class='x'>Welcome to this site</div>"
    rows = [(i, f"http://www.a.org/{i}", f"<body>{banner}<p>story {i}</p></body>") for i in range(6)]
    rows += [(10, "http://b.org/1", f"<body>{banner}<p>other</p></body>"), (11, None, None), (12, "http://a.org/x", "")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"story {i}" for i in range(6)]
    assert got[10] == "Welcome to this site\nother"
    assert got[11] == got[12] == ""


def test_deep_nesting_and_copies_of_an_article(spark):
    rows = [(i, "http://a.org/", "<div>" * 3000 + "deep" + "</div>" * 3000) for i in range(2)]
    rows += [(i, "http://c.org/", "<nav>m</nav><article><p>same story</p></article>") for i in range(10, 30)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep"
    assert got[10] == "same story"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op3(spark, tiny):
    rows = H.op3(spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 for r in rows)


def test_copies_of_a_page_without_an_article_keep_their_text(spark):
    page = "<body><div class='x'>Welcome to this site</div><div><p>story {0}</p><p>end of {0}</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page.format(max(i, 4))) for i in range(15)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {max(i, 4)}\nend of {max(i, 4)}" for i in range(15)}


def test_boxes_that_recur_within_articles_are_deleted(spark):
    box = "<div class='zz'><h3>Our letter</h3><p>Get it weekly</p></div>"
    page = "<nav>m</nav><article><h1>T{0}</h1><p>story {0} is <em>not</em> short</p>{1}<table><tr><td>yes<td>{0}</table></article>"
    rows = [(i, f"http://a.org/{i}", page.format(i, box)) for i in range(8)]
    rows += [(i, "http://b.org/", page.format(0, box) + f"<p>{i}</p>") for i in range(20, 28)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"T{i}\nstory {i} is not short\nyes\n{i}" for i in range(8)]
    assert {got[i] for i in range(20, 28)} == {"T0\nstory 0 is not short\nOur letter\nGet it weekly\nyes\n0"}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div><h1>t</h1><p>the story</p></div><article class='comment'>c1</article><article class='comment'>c2</article>", "t\nthe story"),
        ("<main></main><div>the story</div><article class='comment'>c</article>", "the story"),
        ("<div><p>a story of many words</p></div><article class='zz'>t1</article><article class='zz'>t2</article>", "a story of many words\nt1\nt2"),
        ("<main><div>a story of many words</div><article class='zz'>t1</article><article>t2</article></main><p>y", "a story of many words\nt1\nt2"),
        ("<div>a story of many words</div><section class='comments'><article>c</article></section>", "a story of many words\nc"),
        ("<div>y</div><article>a story of many words</article><article>another</article>", "a story of many words\nanother"),
        ("<div>a note of many words</div><article>x</article>", "x"),
    ],
)
def test_text_of_a_story_beside_articles(source, want):
    assert H.Page(source).text() == want


def by_plain_counts(pages, least, share):
    """Template subtrees of each host, counted in dictionaries."""
    seen, whole = {}, {}
    for url, source in pages:
        page, at = H.Page(source), url.split("/")[2].removeprefix("www.")
        kinds = (source, " ".join(map(str, page.articles())))
        for within, own in enumerate(page.templates()):
            if within and not kinds[1]:
                continue
            whole.setdefault((at, within), set()).add(kinds[within])
            for x in own:
                seen.setdefault((at, within, x), set()).add(kinds[within])
    out = {}
    for (at, within, x), own in seen.items():
        if len(own) >= max(least, share * len(whole[at, within])):
            out.setdefault(at, set()).add(x)
    return out


def test_counts_against_plain_ones(spark):
    rng = random.Random(4)
    boxes = [f"<div class='b{i}'><p>box {i}</p><span>of a <b>site</b></span></div>" for i in range(12)]
    rows = []
    for i in range(120):
        own = "".join(b for j, b in enumerate(boxes) if rng.random() < j / 12)
        story = f"<p>story {i % 100} of {rng.choice(['old', 'new'])} days</p>"
        body = f"<div class='top'>{own}</div><article><h1>T{i}</h1>{story}{own}</article>" if i % 2 else f"{own}<div>{story}</div>"
        rows.append((i, f"http://www.h{i % 3}.org/{i}", f"<body>{body}</body>"))
    found = by_plain_counts([r[1:] for r in rows], H.LEAST_PAGES, H.SHARE)
    want = {i: H.Page(s).text(frozenset(found.get(u.split("/")[2].removeprefix("www."), ()))) for i, u, s in rows}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert sum(want[i] != H.Page(s).text() for i, _, s in rows) == len(rows)


#: Names of true parts of articles that hold a word of boilerplate.
TRUE_NAMES = """notice|ad-hoc|share-price|notices|comment-on-policy|search-engines|menu-of-the-day|social-policy|related-work|banner-year|sidebar-story|header-image-caption|widget-makers|promotion|reply-brief|sponsored-bills|advertising-standards|footer-traffic|navigation-aids|recommended-dose|share|respond""".split("|")


def test_articles_keep_parts_with_such_names_and_lose_adverts_and_notices(spark):
    """Pages put together from known parts, without a look at how they are taken apart."""
    junk = [
        "<div class='ad'>Buy this now</div>", "<div class='cookie-notice'>We use cookies</div>", "<div class='notice'>Sign in to go on <button>Sign in</button></div>", "<section class='comments'><p>First!</p></section>",
        "<div class='share-buttons'><a href='/a'>Tweet this</a> <a href='/b'>Mail it</a></div>", "<ul class='related-posts'><li><a href='/x'>Another story</a></ul>", "<div class='subscribe'>Never miss one <input name='m'></div>", "<p class='sponsored'>Paid for by a firm</p>",
        "<div id='google-ad-top'>Cheap flights</div>", "<div class='advert wide'>Shoes</div>", "<div class='newsletter'>Our letter</div>", "<nav><a href='/'>Home</a></nav>",
    ]
    rows, want = [], {}
    for i, name in enumerate(TRUE_NAMES):
        tag = ("div", "p", "section")[i % 3]
        part = f"The council met on day {i} &amp; heard the {name.replace('-', ' ')} at length."
        inner = f"<p>{part}</p>" if tag != "p" else part
        body = f"<h1>Title {i}</h1><p>Opening of {i}.</p>{junk[i % len(junk)]}<{tag} class='{name}'>{inner}</{tag}>{junk[(i * 5 + 1) % len(junk)]}<p>End of {i}.</p>"
        rows.append((i, f"http://h{i}.org/", f"<html><body><header>Site</header><article>{body}</article><footer>Foot</footer></body></html>", 1))
        want[i] = f"Title {i}\nOpening of {i}.\n{part.replace('&amp;', '&')}\nEnd of {i}."
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want
