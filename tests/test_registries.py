"""Registries and claims on small fixtures."""

import json

from pyspark.sql import functions as F

from quarrymill.operators import registries as R


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_decisions_and_rulings(spark):
    d = spark.createDataFrame([("D-001-1", "resolved", "yes", None), ("D-001-1", "resolved", None, "x"), ("bad", "pending", None, None), ("D-001-2", "pending", None, "high")], "id string, status string, resolution string, impact string")
    assert pairs(R.decision_problems(d)) == {("D-001-1", "recorded-twice"), ("D-001-1", "no-resolution"), ("D-001-1", "impact-after-resolution"), ("bad", "bad-id"), ("bad", "pending-without-impact")}
    long = "checked on both pages on the day of the crawl, the build "
    r = spark.createDataFrame([("a", "kept", "short"), ("b", "reworded", long + "differs"), ("c", "reworded", long + "says more")], "key string, verdict string, why string")
    assert pairs(R.ruling_problems(r)) == {("a", "short-reason"), ("b", "no-wording")}
    assert pairs(R.stale_rulings(r, r.filter("key <> 'c'"))) == {("c",)}


def test_manifests(spark):
    s = "path string, file string, kind string, origin string, entry string"
    good = [("/", "index.html", "page", "static", None), ("/a/", "a/index.html", "page", "post", "posts/a@en")]
    assert R.manifest_problems(spark.createDataFrame(good, s)).count() == 0
    bad = good + [("/a/", "b.html", "page", "post", None), ("x", "", "leaf", "moon", None)]
    assert pairs(R.manifest_problems(spark.createDataFrame(bad, s))) == {("/a/", "path-claimed-twice"), ("/a/", "content-without-entry"), ("/a/", "page-file-mismatch"), ("x", "path-not-rooted"), ("x", "no-file"), ("x", "unknown-kind"), ("x", "unknown-origin")}


def test_claims(spark):
    e = spark.createDataFrame([("p/a.md", "posts/a@en", "wordpress", 7, "post", None), ("p/b.md", "posts/b@en", "wordpress", 7, "post", None), ("p/c.md", "posts/c@en", "authored", None, "post", None)], "file string, id string, system string, source_id long, type string, locale string")
    a = spark.createDataFrame([("authors.json", "x", "wordpress", 7)], "file string, slug string, system string, source_id long")
    c = R.provenance_claims(e, [("authors", a)])
    assert c.count() == 4 and c.filter("source is null").count() == 1
    assert [(r["key"], r["claimants"]) for r in R.contested_claims(c).collect()] == [("wp:post/post#7", "posts/a@en,posts/b@en")]


def test_media_references(spark):
    e = spark.createDataFrame([("a.md", '---\nimage:\n  url: "/u/f.png"\n---\n![x](/u/b.png) <img src="/u/c.png">')], "file string, text string")
    j = spark.createDataFrame([("r.json", json.dumps([{"avatar": {"url": "/u/d.png"}, "name": "n"}])), ("bad.json", "{")], "file string, text string")
    assert pairs(R.media_references(e, j)) == {("a.md", "front-matter", "/u/f.png"), ("a.md", "markdown", "/u/b.png"), ("a.md", "src", "/u/c.png"), ("r.json", "[0].avatar.url", "/u/d.png"), ("bad.json", "invalid-json", None)}


def test_long_dates(spark):
    d = F.lit("2024-08-05").cast("date")
    got = spark.range(1).select(*[R.long_date(d, x).alias(x) for x in R.MONTHS]).first().asDict()
    assert got == {"en": "August 5, 2024", "fr": "5 août 2024", "de": "5. August 2024", "es": "5 de agosto de 2024"}
