"""The content contract: a sound tree has no findings, and each broken rule is named."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.url import MediaProfile
from quarrymill.operators import contract as C
from quarrymill.sources import structured as X

SITE = C.Site(("en", "fr"), "en", MediaProfile(hosts=("source.example",)))
POST = "slug: one\ntitle: One\nlocale: en\ncluster: posts/one\nupdatedAt: 2026-01-10\npublishedAt: 2026-01-10\nauthor: jane\ncategories:\n  - news\nsource:\n  system: wordpress\n  sourceId: 7\n  capturedAt: 2026-01-01\nfeaturedImage:\n  url: /wp-content/uploads/a.png\n  width: 3\n  variants:\n    - x"
PAGE = "slug: about\ntitle: About\nlocale: en\ncluster: pages/about\nupdatedAt: 2026-01-10\nsource:\n  system: authored"
AUTHORS = [{"slug": "jane", "name": "Jane", "source": {"system": "authored"}}]
TERMS = [{"slug": "news", "name": {"en": "News", "fr": "Nouvelles"}, "source": {"system": "authored"}}]
OVERRIDES = [{"path": "/a/", "locale": "en", "robots": {"noindex": True}, "source": {"system": "authored"}}]


def found(spark, post=POST, page=PAGE, authors=AUTHORS, terms=TERMS, overrides=OVERRIDES, more=(), production=False):
    post = post.replace("\n  variants:\n    - x", "")
    files = [("posts/one.md", "posts", post), ("pages/about.md", "pages", page), *more]
    t = spark.createDataFrame([(f, c, f"---\n{x}\n---\nBody.") for f, c, x in files], "file string, collection string, text string")
    fields = X.front_matter(t).select("file", "fields", "problem")
    entries = t.join(fields, "file").select(F.col("file").alias("at"), "collection", F.when(F.col("problem").isNull(), F.col("fields")).alias("fields"))
    def registry(name, rows):
        r = spark.createDataFrame([(name, rows if isinstance(rows, str) else json.dumps(rows))], "file string, text string")
        return C.flattened(r).select(F.concat("file", F.lit("["), "pos", F.lit("]")).alias("at"), "fields")
    regs = {"authors": registry("authors", authors), "categories": registry("categories", terms), "overrides": registry("overrides", overrides)}
    return sorted(tuple(r) for r in C.validate(entries, regs, SITE, production).collect())


def test_a_sound_tree_has_no_findings(spark):
    assert found(spark) == []


ENTRIES = [
    (POST.replace("title: One\n", ""), {("missing", "title")}), (POST.replace("slug: one", "slug: One"), {("bad-slug", "slug")}), (POST.replace("locale: en", "locale: xx"), {("bad-locale", "locale")}), (POST.replace("2026-01-10\nauthor", "2026-02-30\nauthor"), {("bad-date", "publishedAt")}),
    (POST.replace("cluster: posts/one", "cluster: one"), {("bad-cluster", "cluster")}), (POST + "\ncolour: red", {("unknown-key", "colour")}), (POST.replace("  sourceId: 7\n", ""), {("source-id-is-no-key", "source.sourceId"), ("wordpress-without-identity", "source.sourceId")}),
    (POST.replace("sourceId: 7", "sourceId: a-slug"), {("source-id-is-no-key", "source.sourceId")}), (POST.replace("system: wordpress", "system: moon"), {("bad-choice", "source.system")}), (POST.replace("/wp-content/uploads/a.png", "http://x.example/a.png"), {("bad-media", "featuredImage.url")}),
    (POST.replace("/wp-content/uploads/a.png", "https://x.example/a.png"), set()), (POST.replace("width: 3", "width: 0"), {("bad-count", "featuredImage.width")}), (POST.replace("categories:\n  - news\n", ""), {("missing", "categories")}), (POST, set()),
]


def test_entries_against_their_schema(spark):
    rows = [(str(i), f"---\n{x}\n---".replace("\n  variants:\n    - x", "")) for i, (x, _) in enumerate(ENTRIES)]
    t = X.front_matter(spark.createDataFrame(rows, "file string, text string")).select(F.col("file").alias("at"), "fields")
    got = C.schema_findings(t, "posts", SITE).collect()
    assert [{(r["code"], r["detail"]) for r in got if r["at"] == str(i)} for i in range(len(ENTRIES))] == [w for _, w in ENTRIES]


@pytest.mark.parametrize(
    ("schema", "rows", "want"),
    [
        ("terms", [{**TERMS[0], "name": {"fr": "N"}}, {**TERMS[0], "name": {"en": "N", "xx": "?"}}, {"slug": "x"}, TERMS[0]], [(0, "missing", "name.en"), (1, "unknown-key", "name.xx"), (2, "missing", "name.en"), (2, "missing", "source.system")]),
        ("authors", [{**AUTHORS[0], "nicename": "J J"}, {**AUTHORS[0], "source": {"system": "wordpress", "sourceId": "x", "capturedAt": "2026-01-01"}}], [(0, "bad-nicename", "nicename"), (1, "source-id-is-no-key", "source.sourceId")]),
        ("overrides", [{**OVERRIDES[0], "path": "a?x"}, {**OVERRIDES[0], "robots": {"noindex": "maybe"}}], [(0, "bad-path", "path"), (1, "bad-flag", "robots.noindex")]),
    ],
)
def test_registries_against_their_schema(spark, schema, rows, want):
    t = C.flattened(spark.createDataFrame([("r", json.dumps(rows))], "file string, text string")).select(F.col("pos").cast("string").alias("at"), "fields")
    assert sorted((int(r["at"]), r["code"], r["detail"]) for r in C.schema_findings(t, schema, SITE).collect()) == sorted(want)


def test_a_tree_with_every_fault(spark):
    more = [("pages/b.md", "pages", PAGE), ("pages/c.md", "pages", PAGE.replace("about", "c") + "\nparent: gone"), ("posts/two.md", "posts", POST.replace("one", "two").replace("jane", "joe").replace("- news", "- olds").replace("\n  variants:\n    - x", ""))]
    got = found(spark, more=more, authors=AUTHORS * 2, terms=[{**TERMS[0], "parent": "news"}, {**TERMS[0], "slug": "x", "parent": "gone"}], overrides=OVERRIDES * 2, page=PAGE.replace("authored", "sample"), production=True)
    assert {(c, d) for _, c, d in got} >= {("page-parent", "unknown-parent"), ("term-is-its-parent", "news"), ("unknown-parent", "gone"), ("unknown-authors", "joe"), ("unknown-categories", "olds"), ("source-claimed-twice", "posts/one.md,posts/two.md"), ("identity-claimed-twice", "pages/about.md,pages/b.md"), ("cluster-issue", "duplicate-locale:en:pages/b.md"), ("sample-content", "")}
    assert len(got) == 12


def test_an_entry_without_front_matter_is_unreadable(spark):
    t = spark.createDataFrame([("a.md", "posts", None)], "at string, collection string, fields map<string,array<string>>")
    assert [tuple(r) for r in C.validate(t, {}, SITE).collect()] == [("a.md", "unreadable", "")]
