"""The build audit: a sound build has no findings, and each fault alone is found."""

import pytest

from quarrymill.operators import build_audit as A

PAGE = '<!doctype html><html lang="en"><head><title>T</title><meta name="robots" content="{robots}"></head><body{notice}><main id="main"><h1>T</h1><a href="/b/?x=1#y">b</a><a href="/feed.xml">f</a><a href="//cdn.example/x">c</a>{more}</main></body></html>'
OPEN = "index, follow, max-image-preview:large"
ROUTES = [("/", "index.html", "page"), ("/b", "b/index.html", "page"), ("/search/", "search/index.html", "page"), ("/b/page/2", "b/page/2/index.html", "page"), ("/data", "data.json", "data"), ("/old", "old/index.html", "redirect")]
ROBOTS = {"preview": "User-agent: *\nDisallow: /\n", "production": "User-agent: *\nAllow: /\n"}


def page(path, environment, more=""):
    robots = OPEN if environment == "production" and path != "/search/" else "noindex"
    return PAGE.format(robots=robots, notice=" data-wpk-scope-notice" if environment == "preview" else "", more=more)


def sound(environment):
    files = {f: page(p, environment) for p, f, k in ROUTES if k == "page"}
    files |= {"data.json": "{}", "old/index.html": "moved", "robots.txt": ROBOTS[environment], "sitemap.xml": "<loc>x</loc>" * (2 if environment == "production" else 0), "deployment.json": "{}", "_redirects": "", "redirects.json": "[]"}
    return files


def found(spark, environment, files, routes=ROUTES, redirects=("/old",), overrides=(), samples=(), origin="https://new.example"):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = A.audit(
        t(routes, "path string, file string, kind string"), t(list(files.items()), "file string, text string"), t([(r,) for r in redirects], "from_path string"), t(list(overrides), "path string, noindex boolean"),
        t([(s,) for s in samples], "id string"), A.Site(environment, origin, ("www.Source.example",)),
    )
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("environment", ["preview", "production"])
def test_a_sound_build_has_no_findings(spark, environment):
    assert found(spark, environment, sound(environment)) == []


CASES = [
    ("gone", lambda f: f.pop("search/index.html"), [("missing-file", "search/index.html", "")]),
    ("extra", lambda f: f.update({"x/index.html": page("/x", "production"), "x.json": ""}), [("unclaimed-file", "x/index.html", "")]),
    ("stub", lambda f: f.pop("old/index.html"), [("missing-file", "old/index.html", ""), ("missing-stub", "old/index.html", "/old")]),
    ("link", lambda f: f.update({"b/index.html": page("/b", "production", '<a href="/gone?x">g</a><a href="/gone">g</a><a href="/data/">d</a><a href="#x">x</a><a href="gone">r</a>')}), [("dead-link", "/b", "/gone")]),
    ("upload", lambda f: f.update({"b/index.html": page("/b", "production", '<img src="https://source.example/wp-content/uploads/a.png" srcset="https://else.example/wp-content/uploads/b.png 2x, /wp-content/uploads/c.png 1x">')}), [("stale-upload", "b/index.html", "/wp-content/uploads/c.png"), ("stale-upload", "b/index.html", "https://source.example/wp-content/uploads/a.png")]),
    ("insecure", lambda f: f.update({"b/index.html": page("/b", "production", '<img src="http://x.example/a.png"><a href="http://x.example/">x</a>')}), [("insecure-media", "/b", "http://x.example/a.png")]),
    ("head", lambda f: f.update({"b/index.html": "<html><head></head><body><h1>a</h1><h1>b</h1></body></html>"}), [("h1-count", "/b", "2"), ("no-lang", "/b", ""), ("no-main", "/b", ""), ("no-title", "/b", ""), ("wrong-robots", "/b", "")]),
    ("empty", lambda f: f.update({"b/index.html": None}), []),
    ("notice", lambda f: f.update({"b/index.html": page("/b", "production", "<i data-wpk-scope-notice></i>")}), [("scope-notice", "/b", "")]),
    ("robots", lambda f: f.update({"robots.txt": ROBOTS["preview"]}), [("wrong-robots-txt", "robots.txt", "")]),
    ("sitemap", lambda f: f.update({"sitemap.xml": "<loc>x</loc>"}), [("sitemap-count", "sitemap.xml", "1 of 2")]),
    ("leak", lambda f: f.update({"deployment.json": '{"a": {"wpId" : 1}, "x": "termId"}'}), [("source-id-served", "deployment.json", "wpId")]),
    ("artifact", lambda f: f.pop("_redirects"), [("missing-artifact", "_redirects", "")]),
]


@pytest.mark.parametrize(("name", "change", "want"), CASES, ids=[c[0] for c in CASES])
def test_one_fault(spark, name, change, want):
    files = sound("production")
    change(files)
    got = found(spark, "production", files)
    assert got == want if name != "empty" else {c for c, *_ in got} >= {"no-title", "no-lang"}


def test_decisions_of_the_source(spark):
    asked = [("/b", True), ("/search/", True), ("/data", False), ("/nowhere", True)]
    assert found(spark, "production", sound("production"), overrides=asked) == [("indexed-against-source", "/b", ""), ("indexed-against-source", "/nowhere", "")]
    assert found(spark, "preview", sound("preview"), overrides=asked) == []


def test_samples_and_origin(spark):
    assert found(spark, "production", sound("production"), samples=("posts/x",)) == [("sample-content", "posts/x", "")]
    assert found(spark, "preview", sound("preview"), samples=("posts/x",)) == []
    assert found(spark, "production", sound("production") | {"sitemap.xml": ""}, origin=None) == []
    files = {f: (t or "").replace(" data-wpk-scope-notice", "") for f, t in sound("preview").items()}
    assert {c for c, *_ in found(spark, "preview", files)} == {"no-scope-notice"}


def test_phrases_are_notes(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = [("index.html", "<p>This <b>build</b> is COMING soon"), ("b/index.html", "<script>staging site</script>this build"), ("x.html", "this build")]
    got = A.phrase_notes(t(ROUTES, "path string, file string, kind string"), t(files, "file string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("coming soon", 1), ("this build", 1)]
    assert A.verdict(got) == 1 and A.verdict(got.limit(0)) == 0


def test_nothing(spark):
    assert {c for c, *_ in found(spark, "preview", {}, routes=[], redirects=())} == {"missing-artifact"}
