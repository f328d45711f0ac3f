"""Page text against a plain reading of the pages, and on pages that break one thing at a time."""

import html
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import page_text
from quarrymill.llm.page_text import Page
from tests.llm.test_llm import DATA

SCHEMA = "page_id long, url string, html string, host string, salt string, many string, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "s", "m", "t") for i, u, h in rows], SCHEMA)


def texts(df, **how):
    return {r["page_id"]: r["text"] for r in page_text.extract(df, **how).collect()}


def test_articles_by_force(spark):
    """The test pages are regular enough for patterns."""
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?!/?b>)[a-z0-9]+[^>]*>", " ", body))).split())
    assert texts(df) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<b>a</b>b <i>c</i>", "ab c"), ("<p>a&nbsp;\n\t b<br>c</p>", "a b c"), ("a < b and c > d", "a < b and c > d"), ("<p>x</p><!-- <p>no</p>", "x"), ("<p>x</p><a href='y", "x"),
        ("<article><h1>T</h1><p>one<p>two</article><footer>f</footer>", "T one two"), ("<nav>m</nav><main><p>x</p><aside>s</aside></main>", "x"), ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>f</footer></article>", "T x"),
        ("<article><p>x</p><section class='reader-comments'><article>no</article></section></article>", "x"), ("<div class='article-with-sidebar'><p>x</p></div>", "x"), ("<div class='has-sidebar'><article><p>x</p></article></div>", "x"),
        ("<div id=cookieNotice>no</div><p>x</p><form><input><label>no</label></form>", "x"), ("<form><h1>T</h1><article>x</article></form>", "x"), ("<form><p>a<p>b<p>c<p>d</form>", "a b c d"), ("<script>var a='</p>';</script><style>p{}</style><p>x</p>", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a b c d"), ("<p>x<div class=ad>no</div>y", "x y"), ("&#x41;&#66;&eacute;&unknown;&am", "ABé&unknown;&am"), ("<head><title>no</title><p>x", "x"), ("<p>1</p><script>no", "1"),
        ("<a =b c=d>x</a>", "x"), ("<span/>x", "x"), ("<h2 class='ad'>kept</h2>", "kept"), ("<div role=navigation>no</div>x", "x"), ("<P CLASS='Advert'>no</P>x</I>", "x"),
    ],
)
def test_one_page(source, want):
    assert Page(source).text()[0] == want


def site(n, shape):
    return [(i, "http://User@Host.example:80/a", shape(i)) for i in range(n)]


def test_templates_of_a_site_go(spark):
    """Neither tags nor classes tell: only recurrence does. Passages that documents share stay."""
    word = lambda i: f"text{i} " * 20
    shape = lambda i: f"<div><a href=/x>Home</a> <a href=/{i}>All</a></div><div><p>{word(i)}</p><p>Shared licence line.</p></div><div>Made by us</div>"
    got = texts(pages_of(spark, site(12, shape)))
    assert all("Home" not in t and "Made by us" not in t and word(i).strip() in t for i, t in got.items())
    in_article = lambda i: f"<article><div><i>Subscribe now</i></div><p>{word(i)}</p><p>Shared licence line.</p></article>"
    assert texts(pages_of(spark, site(12, in_article))) == {i: f"{word(i)}Shared licence line." for i in range(12)}


def test_copies_make_no_template(spark):
    shape = lambda i: f"<article><div><p>the same article</p></div></article><p>page {i}</p>"
    assert set(texts(pages_of(spark, site(40, shape))).values()) == {"the same article"}


def test_few_pages_make_no_template(spark):
    shape = lambda i: f"<div><a href=/x>Home</a></div><p>text {i}</p>"
    assert texts(pages_of(spark, site(4, shape))) == {i: f"Home text {i}" for i in range(4)}
    other = [(i, f"http://h{i}.example/", shape(i)) for i in range(20)]
    assert texts(pages_of(spark, other)) == {i: f"Home text {i}" for i in range(20)}


def one_site(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id < 600").withColumn("url", F.regexp_replace("url", "://[^/]*", "://one.example"))


def test_templates_by_force(spark):
    df = one_site(spark)
    nodes, pages = defaultdict(set), set()
    for r in df.collect():
        p = Page(r["html"])
        pages.add(p.key())
        for e, _ in p.candidates():
            nodes[p.digest[e]].add(p.key())
    want = Counter((k, len(v) * 2 >= len(pages)) for k, v in nodes.items() if len(v) >= 5 and len(v) >= len(pages) * 0.01)
    got = Counter((r["node"], r["most"]) for r in page_text.templates(df).collect())
    assert got == want and len(want) > 5


def test_hostile_pages(spark):
    rows = [
        (None, None, None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "", ""), (3, "not a url", "<article>y"), (4, "http://[::1]/", "<p>\ud83d</p>".encode("utf-8", "replace").decode()), (5, "//a.example", "<p>" * 20_000 + "deep" + "<div>" * 3000),
        (6, "http://a.example", "<p>" + "long text " * 100_000), (7, "http://a.example", "&#xD800;&#0;z"), (8, "http://a.example", "<" * 50_000), (9, "http://a.example", "<!--" * 50_000), (10, "http://a.example", "<a b='" * 20_000), (11, "http://a.example", "<b><p></i>" * 5000 + "end"),
    ]
    df = pages_of(spark, rows)
    got = page_text.extract(df)
    assert got.count() == len(rows)
    found = {r["page_id"]: r["text"] for r in got.collect()}
    assert found[1] == "x" and found[2] == "" and found[3] == "y" and found[5] == "deep" and found[6] == ("long text " * 100_000).strip() and found[11] == "end"
    assert texts(df, broadcast=-1) == found
    assert page_text.extract(pages_of(spark, [])).count() == 0


def test_both_joins_agree(spark):
    df = one_site(spark)
    assert Counter(map(tuple, page_text.extract(df).collect())) == Counter(map(tuple, page_text.extract(df, broadcast=0).collect()))
