"""Gates and configuration on small fixtures: a sound input, then one fault at a time."""

from pyspark.sql import functions as F

from quarrymill.functions import config as K
from quarrymill.functions.url import Permalinks
from quarrymill.operators import gates as G
from quarrymill.sources import structured

GOOD = '<html lang="en"><body><nav><a href="/" aria-current="page">Home</a></nav><main><h1>A</h1><section id="s" aria-labelledby="s-title"><h2 id="s-title">B</h2></section></main></body></html>'
CSS = ":focus-visible{outline:2px solid} .btn:focus-visible{outline:none} .link:focus-visible{box-shadow:0 0}"


def audit(spark, html, css=CSS):
    p = spark.createDataFrame([("index.html", html, css)], "file string, html string, css string")
    return sorted(r["detail"] for r in G.accessibility(p, p.select("file")).collect())


def test_accessibility_one_fault_at_a_time(spark):
    assert audit(spark, GOOD) == []
    assert audit(spark, GOOD.replace("h2", "h3")) == ["skipped-level:1>3"]
    assert audit(spark, GOOD.replace("<main>", "").replace("</main>", "")) == ["no-main"]
    assert audit(spark, GOOD.replace('aria-labelledby="s-title"', 'aria-labelledby="gone"')) == ["dangling-name:gone", "unnamed-section:s"]
    assert audit(spark, GOOD.replace('href="/"', 'href="/x/"')) == ["dead-nav-link:/x/", "wrong-current:/x/"]
    assert audit(spark, GOOD, ".a{b:c}") == ["system-rule"]
    assert audit(spark, "<main><h1>x</h1></main>") == ["no-nav:"]


def test_accessibility_baseline(spark):
    p = spark.createDataFrame([("index.html", GOOD, "")], "file string, html string, css string")
    b = spark.createDataFrame([("focus|index.html|system-rule", "later"), ("focus|gone.html|system-rule", "old")], "id string, decision string")
    assert sorted((r["id"], r["severity"]) for r in G.accessibility(p, p.select("file"), b).collect()) == [("focus|gone.html|system-rule", "stale"), ("focus|index.html|system-rule", "baseline")]


def test_focus_and_palette(spark):
    t = spark.createDataFrame([(CSS + ":root{--color-ink:#000;--color-paper:snow;--color-odd:rebecca}",)], "css string")
    assert t.select(G.focus_classes(F.col("css")).alias("c")).first()["c"] == ["link"]
    good, bad = G.palette(t)
    assert {(r["token"], r["hex"]) for r in good.collect()} == {("ink", "#000"), ("paper", "#fffafa")} and [r["token"] for r in bad.collect()] == ["odd"]
    pairs = spark.createDataFrame([("p", "ink", "paper", "text"), ("q", "paper", "paper", "text"), ("r", "ink", "gone", "large")], "pair string, fore string, back string, kind string")
    assert {r["pair"]: r["state"] for r in G.contrast_failures(pairs, good).collect()} == {"p": "ok", "q": "low", "r": "missing-token"}


def test_preview(spark):
    s = "file string, bytes int, text string"
    out = spark.createDataFrame([("index.html", 10, '<a href="/a/">x</a><a href="/b">y</a>'), ("a/index.html", 5, ""), ("c.html", 0, '<base href="/"><p onclick="x">')], s)
    routes = spark.createDataFrame([("index.html",), ("a/index.html",), ("c.html",), ("d.html",)], "file string")
    got = {(r["check"], r["at"], r["detail"]) for r in G.preview(out, routes).collect()}
    assert got == {("routes", "d.html", "missing-file"), ("routes", "c.html", "empty-file"), ("links", "index.html", "/b"), ("base", "c.html", ""), ("scripts", "c.html", "inline-handler")}
    assert [r["detail"] for r in G.preview(out, routes.limit(0)).collect()] == ["missing"]


def test_documents(spark):
    d = spark.createDataFrame([("a.md", "# T\n**Status:** Draft\n**Owner:** x\n**Last updated:** 2024-02-30\n\n### S\n# U\n##  "), ("b.md", "text"), ("c.md", "## X\n# Y")], "file string, text string")
    lines = structured.markdown_lines(d)
    got = {(r["check"], r["at"]) for r in G.markdown(structured.markdown_headings(lines), d).collect()}
    assert got >= {("heading-level-skip", "a.md"), ("heading-multiple-h1", "a.md"), ("heading-none", "b.md"), ("heading-h1-not-first", "c.md")}
    meta = {(r["file"], r["code"]) for r in G.metadata(lines).collect()}
    assert meta == {("a.md", "meta-phase-missing"), ("a.md", "meta-bad-date"), ("b.md", "meta-title"), ("b.md", "meta-block-missing"), ("c.md", "meta-title"), ("c.md", "meta-block-missing")}


def test_release_verdicts(spark):
    say = lambda *s: G.release(spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "id string, state string")).first()["verdict"]
    assert [say("pass"), say("pass", "fail", "review"), say("pass", "not-evaluated")] == ["ready", "blocked", "unresolved"]
    assert G.release(spark.createDataFrame([], "id string, state string")).first()["verdict"] == "unresolved"


def test_bodies_and_conflicts(spark):
    html = '<h1>x</h1><img src="/u/a.png"><a href="https://site.example/p/">l</a>'
    assert G.prepared_body(html, ("site.example",), (), lambda u: "/m/a.png" if u == "/u/a.png" else None) == '<h2>x</h2><img loading="lazy" decoding="async" src="/m/a.png"><a href="/p/">l</a>'
    t = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", ""), ("l", "a"), ("l", ""), (None, "a")], "key string, host string")
    assert [tuple(r) for r in G.media_conflicts(t).collect()] == [("k", "a,b")]


def test_configuration():
    assert K.permalink_problems(Permalinks()) == []
    assert K.permalink_problems(Permalinks(post="/x", pagination="Seite", per_page=0)) == ["no-token:post", "no-trailing-slash:post", "bad-segment:pagination", "not-positive:per_page"]
    assert K.permalink_problems(Permalinks(tag="/t/%nicename%/")) == ["token-not-allowed:tag.nicename"]
    types = [K.PostType("product", "products", "/p/%postname%/"), K.PostType("note", "products", "/n/", False), K.PostType("page", "x", "/%postname%/")]
    assert K.post_type_problems(types) == ["repeated-collection:products", "reserved:page", "no-token:note"]
    own = [K.Taxonomy("category", "c", "/c/%slug%/"), K.Taxonomy("shelf", "s", "/s/%slug%/", ("note", "gone"), url_hierarchy=True)]
    assert K.taxonomy_problems(own, types) == ["core-redefined:category", "withheld-type:shelf.note", "unknown-type:shelf.gone", "hierarchy-in-url-only:shelf"]
    assert [t.held_in for t in K.taxonomies(Permalinks(), own[1:])] == ["field", "field", "terms"]
    assert K.resolve_markup(["b"], {"b": {"hidden": ("x",)}}, {"hidden": ("y",)}) == {"hidden": ("y", "x")}
    assert K.form_problems([("a", "t"), ("a", "t"), ("z", "t")], ["a", "b"]) == ["routed-twice:a", "unknown-form:z", "no-route:b"]


def test_signoffs_and_crumbs():
    s = [{"commit": "c1", "digest": "d1"}]
    assert [K.signoff(None, "d1", {}, s), K.signoff("c1", "d2", {}, s), K.signoff("c2", "d1", {"c1": "yes"}, s), K.signoff("c2", "d1", {}, s), K.signoff("c2", "d2", {}, s), K.signoff("c2", "d", {}, [])] == [(False, "no-commit"), (True, "exact"), (True, "carried"), (False, "ancestry-unknown"), (False, "changed-since"), (False, "never-signed")]
    trail = K.crumbs([("Blog", "/blog/")], "Post")
    assert K.breadcrumb_json(trail, "https://x/")["itemListElement"][1] == {"@type": "ListItem", "position": 2, "name": "Blog", "item": "https://x/blog/"}
    assert K.breadcrumb_json(trail[:1], "https://x") is None
