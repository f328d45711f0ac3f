"""The documentation gate on small trees."""

import pytest

from quarrymill.operators import docs as D


@pytest.mark.parametrize(
    ("text", "inline", "uses"),
    [
        ("[a](b.md)", [("a", "b.md")], []), ('![i](<x y.png> "t") [c]( d.md )', [("i", "x y.png"), ("c", "d.md")], []), ("[a] (no) [b][]", [], [("b", "b")]), ("[t][L x] [B2] [d](e(f).md)", [], [("t", "L x")]),
        ("[[in](x)](y)", [("[in", "x")], []), ("[]( )", [("", "")], []), ('[a](b "open) [c](d)', [("c", "d")], []), ("[a", [], []),
    ],
)
def test_links_of_a_line(text, inline, uses):
    assert D.inline_links(text) == inline and D.reference_uses(text) == uses


@pytest.mark.parametrize(("text", "want"), [("[a]: b", ("a", "b")), ("   [A b]:  <c.md> x", ("A b", "c.md")), ("    [a]: b", None), ("[a]:", None), ("[a] : b", None), ("x [a]: b", None)])
def test_definitions(text, want):
    assert D.definition(text) == want


@pytest.mark.parametrize(("heading", "want"), [("A `b` *c*", "a-b-c"), ("[L](x.md) and ![i][r]!", "l-and-i"), ("Größe – 2.0 (x_y)", "größe--20-xy"), ("!!", "")])
def test_anchors(heading, want):
    assert D.anchor_of(heading) == want


TREE = {
    "README.md": "# Top\n[a](docs/a.md#part) [b](docs/) [c](docs/img.png#x) [d](#top) [e](./docs/../docs/a.md)",
    "docs/a.md": "# A\n## Part\n## Part\n[r][Ref] [top](../README.md) [x](#part-1) `[no](no.md)`\n\n[ref]: ../README.md#top\n[ext]: https://x.example/\n```\n[no](no.md)\n```\n[m](mailto:x@y) [e](https://x)",
}


def found(spark, change=None):
    t = spark.createDataFrame(list({**TREE, **(change or {})}.items()), "file string, text string")
    r = D.rows(t)
    return sorted((x["file"], x["line"], x["rule"], x["detail"]) for x in D.link_findings(r, t.select("file"), spark.createDataFrame([("docs/img.png",)], "file string")).collect())


def test_a_sound_tree(spark):
    assert found(spark) == []


FAULTS = [
    ("[x]()", ("link-empty", "")), ("[x](/docs/a.md)", ("link-absolute-path", "/docs/a.md")), ("[x](../../a.md)", ("link-escapes-repository", "../../a.md")), ("[x](gone.md)", ("link-target-missing", "docs/gone.md")),
    ("[x](a.md#no)", ("link-anchor-missing", "docs/a.md#no")), ("[x](#no)", ("link-anchor-missing", "docs/b.md#no")), ("[x][No]", ("link-reference-undefined", "no")), ("[x]: gone%20x.md", ("link-target-missing", "docs/gone x.md")), ("[x]: ok\n[X]: a.md", None),
    ("[x](a.md#pa%72t)", None), ("[x](%zz.md)", ("link-target-missing", "docs/%zz.md")), ("~~~\n[x](no.md)\n```\n~~~", None),
]


@pytest.mark.parametrize(("text", "want"), FAULTS)
def test_one_fault(spark, text, want):
    assert found(spark, {"docs/b.md": text}) == ([("docs/b.md", 1, *want)] if want else [])


def test_the_gate(spark):
    good = "# T\n**Status:** Draft\n**Owner:** x\n**Last updated:** 2026-01-01\n**Phase:** 1\n\n[a](b.md#t)"
    t = spark.createDataFrame([("a.md", good), ("b.md", good.replace("b.md#t", "a.md#u")), ("c.md", None)], "file string, text string")
    got = sorted((r["file"], r["rule"]) for r in D.audit(t, t.select("file").limit(0)).collect())
    assert got == [("b.md", "link-anchor-missing"), ("c.md", "heading-none"), *sorted(x for x in got if x[0] == "c.md" and x[1] != "heading-none")] and ("c.md", "heading-none") in got
    assert D.audit(t.limit(0), t.select("file").limit(0)).count() == 0
