"""Lineage both ways on a small build."""

import pytest

from quarrymill.operators import provenance as P

SAID = "origin string, source string, collection string, locale string, declared_by string"


def built(spark):
    intended = [("posts/a@en", "wordpress", None, "posts", "en", None, "/a/"), ("posts/b@en", "authored", None, "posts", "en", None, "/b/"), ("archive/x", "derived", None, None, None, "posts", None), ("posts/c@en", None, None, None, None, None, None), ("posts/d@en", "wordpress", "wp:old#1", None, None, None, None)]
    inventory = [("/a/", "a/index.html", "posts/a@en"), ("/", "index.html", "archive/x"), ("/page/2/", "page/2/index.html", "archive/x"), ("/both", "both.html", "posts/a@en"), ("/both/", "/both.html", "posts/d@en"), ("/free/", "free.html", None), ("/lost/", "lost.html", "posts/gone@en")]
    claims = [("posts/a@en", "wordpress", "wp:post/post#7@en", "posts", "en", None, 1), ("posts/d@en", "wordpress", "wp:post/post#9@en", "posts", "en", None, 1), ("posts/d@en", "wordpress", "wp:post/post#7@en", None, "en", None, 2), ("posts/gone@en", "wordpress", "wp:post/post#8@en", None, None, None, 1)]
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return P.edges(t(intended, f"id string, {SAID}, expected_route string"), t(inventory, "path string, file string, entry string"), t(claims, f"id string, {SAID}, pos int"))


def test_lineage(spark):
    got = {r["id"]: r.asDict() for r in P.lineage(built(spark)).collect()}
    assert set(got) == {"posts/a@en", "posts/b@en", "archive/x", "posts/c@en", "posts/d@en"}
    a, d, x = got["posts/a@en"], got["posts/d@en"], got["archive/x"]
    assert (a["origin"], a["source"], a["n_routes"], a["route"], a["output"], a["withheld"]) == ("wordpress", "wp:post/post#7@en", 2, "/a", "a/index.html", False)
    assert (d["source"], d["collection"], d["locale"]) == ("wp:post/post#7@en", None, "en")  # the last claim, whole; not the manifest's source
    assert (x["origin"], x["declared_by"], x["n_routes"], x["route"]) == ("derived", "posts", 2, "/")
    assert (got["posts/b@en"]["withheld"], got["posts/b@en"]["expected_route"]) == (True, "/b/") and got["posts/c@en"]["origin"] == "unstated"
    assert P.summary(P.lineage(built(spark))).first().asDict() == {"entities": 5, "wordpress": 2, "derived": 1, "published": 3, "withheld": 2}


@pytest.mark.parametrize(
    ("label", "subjects", "want"),
    [
        ("route", ["/a", "/a///", "/", "/both/", "/free/", "/lost/"], {("/a", "posts/a@en"), ("/a///", "posts/a@en"), ("/", "archive/x"), ("/both/", "posts/d@en"), ("/free/", None), ("/lost/", None)}),
        ("output", ["/a/index.html", "both.html", "no"], {("/a/index.html", "posts/a@en"), ("both.html", "posts/d@en"), ("no", None)}),
        ("source", ["wp:post/post#7@en", "wp:post/post#8@en", "wp:old#1"], {("wp:post/post#7@en", "posts/a@en"), ("wp:post/post#7@en", "posts/d@en"), ("wp:post/post#8@en", None), ("wp:old#1", None)}),
    ],
)
def test_lookups(spark, label, subjects, want):
    t = spark.createDataFrame([(s,) for s in subjects], "subject string")
    assert {tuple(r) for r in P.lookup(built(spark), label, t).collect()} == want
