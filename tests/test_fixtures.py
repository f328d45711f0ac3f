"""Small fixtures for rules that the driver's tables leave vacuous; one fault at a time."""

import json

from pyspark.sql import functions as F

from quarrymill.functions import html as H
from quarrymill.functions import text as T
from quarrymill.functions import url as U
from quarrymill.operators import discovery, dom, hierarchy, identity, inventory, ordering
from quarrymill.operators import rules as R
from quarrymill.operators import transform as X
from quarrymill.sources import files, sinks, structured


def one(spark, column, **values):
    t = spark.range(1)
    for k, v in values.items():
        t = t.withColumn(k, F.lit(v))
    return t.select(column.alias("x")).first()["x"]


def many(spark, f, inputs):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["x"] for r in t.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_families(spark):
    keys = ["/", "/?s=x", "/a/?b=1", "/de/x/", "/wp-admin/", "/wp-content/x.png", "/sitemap.xml", "/a/feed/", "/a.html", "/blog/page/2/", "/2024/05/", "/blog/2024/", "/blog/", "/category/a/", "/tag/b/", "/author/c/", "/one/", "/one/two/"]
    want = ["front-page", "search", "query-variant", "translated", "wp-internal", "media", "sitemap", "feed", "media", "pagination", "date-archive", "date-archive", "posts-index", "category", "tag", "author", "entry", "page"]
    assert many(spark, lambda c: U.classify_family(c, U.Permalinks(languages=("de",))), keys) == want


def test_posts_under_a_prefix_beat_pages_at_the_root(spark):
    links = U.Permalinks(post="/blog/%postname%/")
    assert many(spark, lambda c: U.classify_family(c, links), ["/blog/x/", "/x/", "/x/y/"]) == ["post", "page", "page"]


def test_comparison_keys(spark):
    urls = ["https://a.example/x", "https://a.example/x.png?q=1#f", "mailto:a@b", "https://b.example/x", "https://a.example", "https://a.example/%E3%81%82/%2F"]
    assert many(spark, lambda c: U.comparison_key(c, F.lit("https://a.example")), urls) == ["/x/", "/x.png?q=1", None, None, "/", "/あ/%2F/"]


def test_slugs(spark):
    assert many(spark, U.is_slug, ["a-b", "A-b", "a--b", "-a", "あ-い", "a_b", ""]) == [True, False, False, False, True, True, False]


def test_splat_is_a_string_prefix_and_not_migrated_is_by_segment(spark):
    live = spark.createDataFrame([("/france/", "page"), ("/fr/", "page"), ("/x/", "page")], "key string, family string")
    local = spark.createDataFrame([("/nowhere/", False)], "key string, redirect boolean")
    rules = spark.createDataFrame([], "from_path string, to_path string")
    got = {r["key"]: r["classification"] for r in inventory.diff(live, local, rules, (("/fr", 1),), ()).collect()}
    assert got == {"/france/": "REDIRECT", "/fr/": "REDIRECT", "/x/": "GAP", "/nowhere/": "LOCAL_ONLY"}


def test_rules_meet_normalised_targets_and_the_last_wins(spark):
    live = spark.createDataFrame([(f"/{c}/", "page") for c in "abcdef"], "key string, family string")
    local = spark.createDataFrame([("/about/", False), ("/stub/", True), ("/tag/x/", False)], "key string, redirect boolean")
    rules = [("/a/", "/about"), ("/b", "/about/?x=1"), ("/c", "/stub/"), ("/d", "mailto:x@y"), ("/e", "/nowhere/"), ("/e/", "/about/")]
    rules = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "from_path string, to_path string, ord int")
    rows = inventory.diff(live, local, rules, (), ()).collect()
    got = {r["key"]: (r["classification"], r["redirect_target"]) for r in rows}
    assert len(rows) == 8 and got["/a/"] == ("REDIRECT", "/about") and got["/b/"] == ("REDIRECT", "/about/?x=1") and got["/c/"] == ("GAP", "/stub/")
    assert got["/d/"] == ("REDIRECT", "mailto:x@y") and got["/e/"] == ("REDIRECT", "/about/") and got["/f/"] == ("GAP", None)
    assert [(r["classification"], r["family"]) for r in rows if r["key"] == "/tag/x/"] == [("LOCAL_ONLY", "tag")]


def test_redirect_stub_without_rule_is_a_gap_and_never_local_only(spark):
    live = spark.createDataFrame([("/a/", "page")], "key string, family string")
    local = spark.createDataFrame([("/a/", True), ("/b/", True)], "key string, redirect boolean")
    rules = spark.createDataFrame([], "from_path string, to_path string")
    assert [(r["key"], r["classification"]) for r in inventory.diff(live, local, rules, (), ()).collect()] == [("/a/", "GAP")]


def test_empty_inventories(spark):
    live = spark.createDataFrame([], "key string, family string")
    local = spark.createDataFrame([], "key string, redirect boolean")
    rows = inventory.diff(live, local, spark.createDataFrame([], "from_path string, to_path string"), (), ())
    assert rows.count() == 0
    assert {r["n"] for r in inventory.counts(spark, rows).collect()} == {0}


def test_assets(spark):
    p = U.MediaProfile(hosts=("site.example",), extra=("files",))
    refs = ["", "#x", "mailto:a", "//www.site.example/wp-content/uploads/a.png", "/wp-content/uploads/", "/wp-content/uploads/../b", "http://else.example/wp-content/uploads/a.png", "/files/a.pdf", "/media/a.png", "a.png", "http://site.example/other.png"]
    want = ["UNSUPPORTED"] * 3 + ["SUPPORTED", "UNSUPPORTED", "UNSUPPORTED", "EXTERNAL", "CONFIGURED", "SUPPORTED", "UNSUPPORTED", "EXTERNAL"]
    assert many(spark, lambda c: U.identify_asset(c, p)["classification"], refs) == want
    assert many(spark, lambda c: U.identify_asset(c, p)["key"], ["https://site.example/wp-content/uploads/2026/a.png?x#y"]) == ["uploads:2026/a.png"]


def test_says_needs_whole_words(spark):
    say = lambda corpus, key: one(spark, T.says(F.col("c"), F.col("k")), c=corpus, k=key)
    assert say("the cat sat", "cat") and not say("category", "cat") and not say("会社概要", "会社") and say("$9.99/month", "$9.99/month") and say("a \\E b", "\\E")


def test_text(spark):
    assert one(spark, T.visible_text(F.col("h")), h="<p>one<br>two</p><script>x</script><em>a</em>. &amp;lt; &foo;") == "one two a. &lt;"
    assert one(spark, T.bare_text(F.col("h")), h="<b>a</b>b &amp;lt; &#39;") == "ab &lt; '"
    assert one(spark, T.truncate_at_word(F.col("h"), 9), h="one two, three") == "one two…"
    assert one(spark, T.comparison_text(F.col("h")), h="<i>“A”</i> / B–C") == '"a"/b-c'
    assert many(spark, T.builder_of, ['<div class="et_pb_row vc_row">', "plain"]) == ["divi", None]


def test_reconcile_both_ways(spark):
    page = "route string, asked array<string>, said string"
    live = spark.createDataFrame([("/a/", ["buy now", "gone", "kept", "both"], "buy now gone kept both")], page)
    ours = spark.createDataFrame([("/a/", ["new", "both", "fresh"], "buy now both new fresh")], page)
    rulings = spark.createDataFrame([("/a/", "kept"), (None, "kept"), (None, "both"), (None, "fresh"), (None, "old")], "scope string, key string")
    got = inventory.account(live, ours, rulings)
    assert {(r["kind"], r["route"], r["key"]) for r in inventory.reconcile_problems(got, rulings).collect()} == {("unpainted", "/a/", "gone"), ("invented", "/a/", "new"), ("contradicted", "/a/", "both"), ("stale", None, "kept"), ("stale", None, "old")}
    assert inventory.reconcile_problems(got, rulings).count() == 5
    assert tuple(inventory.reconcile_routes(got).first()) == ("/a/", 4, 3, 2, 1, 1)


def test_provenance_findings(spark):
    own = [("a", None, False, None), ("b", "wordpress", True, "x"), ("c", "derived", False, ""), ("d", "derived", False, "y"), ("d", "sample", False, None)]
    t = spark.createDataFrame(own, "id string, origin string, has_source boolean, derived_by string")
    claims = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "key string, by string")
    got = sorted(tuple(r) for r in inventory.provenance_findings(t, claims).collect())
    assert got == [("IDENTITY_CONTESTED", "d"), ("PROVENANCE_CONTESTED", "k"), ("PROVENANCE_MISSING", "a"), ("PROVENANCE_MISSING", "b"), ("PROVENANCE_MISSING", "b"), ("PROVENANCE_MISSING", "c")]


def test_form_settings(spark):
    from quarrymill.functions import routes as N

    assert many(spark, N.endpoint_variable, ["contact-us"]) == ["WPK_FORM_ENDPOINT_CONTACT_US"]
    assert many(spark, N.transport_of, [None, " ", "https://a.example/x", "http://a.example", "https://a b"]) == ["undecided", "undecided", "http-post", "refused", "refused"]


def test_entities_are_decoded_once(spark):
    got = many(spark, T.decode_entities, ["&#65;&#x42;&#X1F600; &amp;lt; &AMP; &nbsp;|&hellip;&mdash;", "&unknown; & &#xD800; &#1114112;", "plain", "", "&#039;a&quot;"])
    assert got == ["AB😀 &lt; &  |…—", "&unknown; & &#xD800; &#1114112;", "plain", "", "'a\""]


def test_first_prose(spark):
    bodies = ["# T\n\n::: note\n---\n- a\n1) b\n#hashtag **bold** [link](/x) ![i](/y)`c`\nmore", "<h2>x</h2><p class=a>One <b>two</b></p>", "a<p></p>\nline", "<div>x</div>\n  <img src=x>\nlast", "> q\r\n  text  here ", "# only", ""]
    assert many(spark, T.first_prose, bodies) == ["#hashtag bold link c", "One two", "", "last", "text here", "", ""]


def test_archives_say_what_they_list(spark):
    one_of = lambda k: one(spark, T.archive_description(F.lit(k), F.col("h"), F.lit("Site"), F.lit("topic")), h="T")
    assert one_of("posts") == "Every post published on Site, newest first — the full archive."
    assert one_of("term") == "Everything filed under the topic T on Site, newest first — the full archive."
    own = lambda c: T.term_description(c, F.lit("T"), F.lit("Site"), F.lit("topic"))
    assert many(spark, own, ["x" * 49, " " + "x" * 50 + " "]) == [one_of("term"), "x" * 50]


def test_template_families(spark):
    assert many(spark, U.template_family, ["index.html", "about/index.html", "blog/a/index.html", "blog/page/2/index.html"]) == ["top-level", "top-level", "blog", "blog-pagination"]


def test_search_folds_marks(spark):
    s = "id string, title string, summary string, categories array<string>, tags array<string>, locale string, date string"
    t = spark.createDataFrame([("a", "Dvořák", None, ["Señor Tag"], None, "en", "1"), ("b", "other", "x dvorak", [], [], "en", "2")], s)
    assert [(r["id"], r["score"], r["matched"]) for r in discovery.search(t, "dvorak", "en").orderBy("rank").collect()] == [("a", 4, "title"), ("b", 1, "summary")]
    assert [r["id"] for r in discovery.search(t, "Dvořák senor", "en").collect()] == ["a"]


def test_related_by_force(spark):
    import random

    r = random.Random(7)
    some = lambda names, most: [r.choice(names) for _ in range(r.randint(0, most))]
    data = [(i, r.choice("ab"), r.randint(0, 9), some("pqr", 3), some("uvwxyz", 11 if i % 9 == 0 else 4)) for i in range(120)]
    t = spark.createDataFrame(data, "id int, locale string, date int, categories array<string>, tags array<string>")
    want = set()
    for i, loc, _, cats, tags in data:
        score = {}
        for j, loc2, date, cats2, tags2 in data:
            n = sum(2 for c in cats if c in cats2) + sum(1 for c in tags if c in tags2)
            if i != j and loc == loc2 and n:
                score[j] = (-n, -date, j)
        want |= {(i, j, -score[j][0], k + 1) for k, j in enumerate(sorted(score, key=score.get)[:3])}
    for few in (8, 2):
        old, discovery.FEW = discovery.FEW, few
        try:
            assert {tuple(x) for x in discovery.related(t).collect()} == want
        finally:
            discovery.FEW = old


def test_references(spark):
    html = """<img src="/a.png" srcset="/b.png 1x, /c.png 2x"><div style="background:url(&quot;/d.png&quot;)"></div>![x](/e.png "t")"""
    got = one(spark, H.references(F.col("h")), h=html)
    assert [(r["url"], r["kind"]) for r in got] == [("/a.png", "src"), ("/b.png", "srcset"), ("/c.png", "srcset"), ("/d.png", "css"), ("/e.png", "markdown")]
    got = one(spark, H.references(F.col("h")), h="""<img src="" data-srcset='/b.png 1x,, /c.png' data-src=/no><i style="background: url( '/d.png' )"></i>url()""")
    assert [(r["url"], r["kind"]) for r in got] == [("/b.png", "srcset"), ("/c.png", "srcset"), ("/d.png", "css")]
    links = one(spark, H.link_references(F.col("h")), h="<a href=/x>1</a><a href=''>2</a><link href='/s.css'>")
    assert [(r["tag"], r["raw"]) for r in links] == [("a", "/x"), ("link", "/s.css")]


def test_seo_rules_each_alone(spark):
    good = '<html lang="en"><head><title>A page</title><meta name="description" content="' + "d" * 60 + '"><link rel="canonical" href="https://x/"></head></html>'
    cases = [good, good.replace("A page", "t" * 61), good.replace("d" * 60, "short"), good.replace('<link rel="canonical" href="https://x/">', ""), good.replace(' lang="en"', ""), good.replace("<title>A page</title>", "")]
    t = spark.createDataFrame([(i, h.replace("A page", f"A page {i}")) for i, h in enumerate(cases)], "page int, html string")
    got = {(r["page"], r["code"]) for r in R.seo_findings(t, "page", "html").collect()}
    assert got == {(1, "title-too-long"), (2, "description-too-short"), (3, "canonical-missing"), (4, "lang-missing"), (5, "title-missing")}


def test_chains_and_loops(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("l1", "l2"), ("l2", "l1"), ("s", "s"), ("o", "gone"), ("p", "o")], "slug string, parent string")
    got = {r["slug"]: (r["chain"], r["state"]) for r in hierarchy.chains(t).collect()}
    assert got["d"] == (["a", "b", "c", "d"], "ok")
    assert {k for k, v in got.items() if v[1] == "cycle"} == {"l1", "l2", "s"}
    assert {k for k, v in got.items() if v[1] == "unknown-parent"} == {"o", "p"}


def test_walk_is_tolerant():
    w = dom.walk("<div><p>a<b>x<br/></p>y</div></span><ul><li>z")
    assert [(n, d) for _, n, d, *_ in w] == [("div", 0), ("p", 1), ("b", 2), ("br", 3), ("ul", 0), ("li", 1)]
    ends = {n: e for _, n, _, _, e, _ in w}
    assert ends["b"] == -1 and ends["li"] == -1 and ends["p"] > 0


def test_elements_and_surfaces(spark):
    t = spark.createDataFrame([(1, '<h1>Hi “you”</h1><div aria-hidden="true"><h2>No</h2></div><a href="/x">Go</a><a>Go</a>'), (2, None)], "page int, html string")
    assert dom.elements(t, "page", "html").filter("name = 'a'").count() == 2
    r = dom.surfaces(t, "page", "html").orderBy("key").first()
    assert [(a["key"], a["kind"]) for a in r["asked"]] == [('hi "you"', "h1"), ("go", "a")] and "no" not in r["said"].split()


def test_folding_keeps_marks_of_other_scripts():
    assert dom.folded("Café") == "cafe" and dom.folded("だいじ") != dom.folded("たいし") and dom.composed("é") == "é"


def test_rewriting(spark):
    html = '<a href="https://www.site.example/x/">1</a><a href="/forum/y">2</a><a href="https://site.example/f.pdf">3</a>'
    assert dom.internalised(html, ("site.example",), ("/forum",)) == '<a href="/x/">1</a><a href="https://site.example/forum/y">2</a><a href="https://site.example/f.pdf">3</a>'
    assert dom.rewritten('<img src="/u/a.png" srcset="/u/a.png 1x, /v 2x">![i](/u/a.png)', lambda u: "/media/a.png" if u == "/u/a.png" else None) == '<img src="/media/a.png" srcset="/media/a.png 1x, /v 2x">![i](/media/a.png)'
    t = dom.map_text(spark.createDataFrame([("a",), (None,)], "h string"), "h", str.upper)
    assert [r["h"] for r in t.collect()] == ["A", None]


def test_digests(spark):
    s = "file string, label string, numbers array<int>, pos int"
    old = spark.createDataFrame([("a", "x", [1, 2], 0), ("b", "x", [1, 2], 0), ("b", "x", [1, 2], 1), ("c", "x", [1], 0)], s)
    new = spark.createDataFrame([("a", "x", [2, 1], 0), ("b", "x", [1, 2], 0), ("d", "x", [1], 0)], s)
    got = {r["file"]: (r["state"], r["removed"], r["added"]) for r in dom.compare_digests(old, new).collect()}
    assert got == {"a": ("same", 0, 0), "b": ("changed", 1, 0), "c": ("vanished", 1, 0), "d": ("unrecorded", 0, 1)}
    assert dom.greedy_differences([(1, 1)], [(3, 1)]) == (1, 1)


def test_baseline_both_ways(spark):
    f = spark.createDataFrame([("a", "error"), ("b", "error"), ("c", "warning")], "id string, severity string")
    b = spark.createDataFrame([("a", "d1"), ("z", "d2")], "id string, decision string")
    got = {r["id"]: r["severity"] for r in identity.apply_baseline(f, b).collect()}
    assert got == {"a": "baseline", "b": "error", "c": "warning", "z": "stale"}


def test_fingerprint_of_nothing(spark):
    assert identity.fingerprint(spark.createDataFrame([], "n string, v string"), "n", "v").first()["fingerprint"] == "unavailable"


def test_pagination_edges(spark):
    g = spark.createDataFrame([("none",), ("one",), ("ten",), ("eleven",)], "g string")
    items = spark.createDataFrame([("one", 1)] + [("ten", i) for i in range(10)] + [("eleven", i) for i in range(11)], "g string, i int")
    got = ordering.paginate(items, "g", [F.col("i")], 10, g).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["g"]: r["n"] for r in got} == {"none": 1, "one": 1, "ten": 1, "eleven": 2}


def test_short_bodies_need_eight(spark):
    t = spark.createDataFrame([(i, 100 if i else 1, None) for i in range(7)], "id int, length int, builder string")
    assert ordering.body_report(t).filter("reason is not null").count() == 0
    t = t.unionByName(spark.createDataFrame([(8, 100, "divi")], "id int, length int, builder string"))
    assert {(r["id"], r["reason"]) for r in ordering.body_report(t).filter("reason is not null").collect()} == {(0, "short"), (8, "builder")}


def test_ladder_conserves(spark):
    s = "id int, kind string, status string, protected boolean, body string, slug string, date string, modified string, title string, author string, categories array<string>, pos int"
    good = ("publish", False, "b", "a", "2024-01-01T09:30:00", None, "T", "x", ["c"])
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("status", "protected", "body", "slug", "date", "modified", "title", "author", "categories"), good))
    rows = [
        ("post", good, None), ("post", good, "duplicate-slug"), ("page", good, None), ("post", change(status="draft", title=""), "not-published"), ("post", change(status=None, slug="n"), None), ("post", change(protected=True), "password-protected"),
        ("post", change(body=""), "incomplete"), ("post", change(slug="A b"), "unrepresentable-slug"), ("post", change(date=None), "incomplete"), ("post", change(date=None, modified="2024-05-05"), "incomplete"), ("page", change(date=None, modified="2024-05-05", slug="p", author=None, categories=None), None),
        ("post", change(title=" &#160;&nbsp; "), "incomplete"), ("post", change(author=None), "incomplete"), ("post", change(categories=[]), "incomplete"),
    ]
    t = spark.createDataFrame([(i, k, *v, i) for i, (k, v, _) in enumerate(rows)], s)
    got = {r["id"]: r["reason"] for r in X.ladder(t).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(rows)}
    assert X.conservation(t, X.ladder(t)).first()["sound"]


def test_crawl_waves(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "source string, target string")
    got = {r["url"]: r["wave"] for r in hierarchy.crawl_waves(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_front_matter_round_trip(spark, tmp_path):
    (tmp_path / "content" / "posts").mkdir(parents=True)
    (tmp_path / "content" / "posts" / "a.md").write_text('---\ntitle: "On: it"\nsource:\n  system: wordpress\n  sourceId: "7"\ntags:\n  - x\n  - y # note\ncategories: [a, b]\n---\nBody\n')
    (tmp_path / "content" / "posts" / "b.md").write_text("no block")
    (tmp_path / "content" / "README.md").write_text("---\nx: 1\n---\n")
    e = files.entries(spark, str(tmp_path / "content"))
    assert {(r["file"], r["collection"]) for r in e.collect()} == {("posts/a.md", "posts"), ("posts/b.md", "posts")}
    got = {r["file"]: (r["fields"], r["problem"]) for r in structured.front_matter(e).collect()}
    assert got["posts/a.md"] == ({"title": ["On: it"], "source.system": ["wordpress"], "source.sourceId": ["7"], "tags": ["x", "y"], "categories": ["a", "b"]}, None)
    assert got["posts/b.md"][1] == "no-front-matter"
    text = one(spark, sinks.front_matter_text([("title", F.col("t")), ("draft", F.lit("true")), ("none", F.lit(None))], F.lit("B")), t="plain title")
    assert text == '---\ntitle: plain title\ndraft: "true"\n---\nB'


def test_registry_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"slug": "x", "odd": 1}, {"slug": "y"}]))
    (tmp_path / "b.json").write_text("{}")
    rows, problems = structured.registry(spark, str(tmp_path), "struct<slug:string>", ("slug",))
    assert sorted(r["slug"] for r in rows.collect()) == ["x", "y"]
    assert {(r["code"], r["detail"]) for r in problems.collect()} == {("unknown-field", "odd"), ("not-an-array", "")}


def test_redirect_map(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"rules": [{"from": "/a/", "to": "/b", "status": 301, "family": "x"}, {"from": "/c", "to": "/d", "status": 307, "family": ""}], "splats": [{"prefix": "/", "status": 301, "family": "x"}]}))
    got = {(r["at"], r["code"]) for r in structured.redirect_problems(spark, str(f)).collect()}
    assert got == {("/a/", "slash-at-end"), ("/c", "bad-status"), ("/c", "no-family"), ("/", "splat-at-root")}


def test_sitemaps_and_robots(spark):
    assert one(spark, structured.sitemap_urls(F.col("x")), x="<urlset><url><loc> https://a/?x=1&amp;y=2 </loc></url></urlset>") == ["https://a/?x=1&y=2"]
    assert one(spark, structured.robots_sitemaps(F.col("x")), x="User-agent: *\nSITEMAP: https://a/s.xml\n") == ["https://a/s.xml"]
    assert sinks.robots_text(True, "https://a").endswith("Disallow: /\n")


def test_built_site(spark, tmp_path):
    site = tmp_path / "dist"
    (site / "a").mkdir(parents=True)
    (site / "a" / "index.html").write_text('<link rel="canonical" href="https://x/a/"><link rel="stylesheet" href="/s.css"><style>p{}</style>')
    (site / "old.html").write_text('<meta http-equiv="refresh" content="0;url=/a/">')
    (site / "s.css").write_text("b{}")
    got = {r["key"]: (r["canonical"], r["redirect"]) for r in files.built_routes(spark, str(site)).collect()}
    assert got == {"/a/": ("https://x/a/", False), "/old.html": (None, True)}
    assert [r["path"] for r in files.servable_routes(spark, str(site)).collect()] == ["/a/"]
    assert files.html_pages(spark, str(site)).first()["css"] == "p{}\nb{}"
    assert files.listing(spark, str(site)).count() == 3


def test_markdown(spark):
    d = spark.createDataFrame([("a.md", "# One\n```\n# no\n~~~\n```\n## One\n[x](b.md#two) [y](gone.md) `[z](q.md)` [w](https://e)"), ("b.md", "# Two\n```\nopen")], "file string, text string")
    lines = structured.markdown_lines(d)
    heads = structured.markdown_headings(lines)
    assert {(r["file"], r["anchor"]) for r in heads.collect()} == {("a.md", "one"), ("a.md", "one-1"), ("b.md", "two")}
    bad = structured.broken_markdown_links(structured.markdown_links(lines), heads, d)
    assert [(r["target"], r["code"]) for r in bad.collect()] == [("gone.md", "missing-file")]


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text(json.dumps({"routes": [{"path": "/", "file": "index.html"}]}))
    r = structured.manifest_routes(spark, str(f)).first()
    assert (r["kind"], r["origin"]) == ("page", "unknown")
    t = spark.createDataFrame([("/b/", "b", "page", "x"), ("/a/", "a", "page", "x"), ("/a/", "c", "page", "x")], "path string, file string, kind string, origin string")
    m = sinks.manifest_json(t).first()
    assert m["repeated"] == 1 and [x["path"] for x in json.loads(m["json"])["routes"]] == ["/a/", "/a/", "/b/"]
    assert [r["line"] for r in sinks.netlify_lines(spark.createDataFrame([("/a", "/b", 301)], "from_path string, to_path string, status int"), spark.createDataFrame([("/c", 302)], "prefix string, status int")).collect()] == ["/a /b 301", "/c/* /:splat 302"]
    sinks.write_dated(t, str(tmp_path), "2026-01-01", "routes")
    assert spark.read.json(f"{tmp_path}/routes").count() == 3
