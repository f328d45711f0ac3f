"""Style sheets taken apart, and the accessibility audit with one fault at a time."""

import pytest

from quarrymill.operators import accessibility as A
from quarrymill.operators import css as C

FOCUS = ":focus-visible{outline:2px solid}--x{--color-ink:#111111}:root{--color-paper:snow;--color-ink:#111}"
PAGE = '<h1>T</h1><header></header><input type="checkbox" id="t"><label for="t">m</label><nav aria-label="Main"><a href="/">h</a></nav><a class="skip" href="#main">s</a><main id="main" tabindex="-1"><h2>a</h2></main><footer></footer>'
PAIRS = [("ink-paper", "ink", "paper", "text")]


@pytest.mark.parametrize(
    ("css", "want"),
    [
        (".a{color:red}.b , .c > d{x:y;z:w;}", [([".a"], [("color", "red")]), ([".b", ".c > d"], [("x", "y"), ("z", "w")])]),
        ("/* .x{} */ @media (min-width:1px) { .a{b:c} @supports (d:e) { .f{g:h} } }", [([".a"], [("b", "c")]), ([".f"], [("g", "h")])]),
        ("@font-face{font-family:x} @keyframes k{from{a:b}} .a{c:d}", [([".a"], [("c", "d")])]),
        (".a{b:c; &:hover{d:e} .f &{g:h} i{j:k}}", [([".a:hover"], [("d", "e")]), ([".f .a"], [("g", "h")]), ([".a i"], [("j", "k")]), ([".a"], [("b", "c")])]),
        (".a{b:c; @media print{d:e}}", [([".a"], [("d", "e")]), ([".a"], [("b", "c")])]),
        ('.a::before{content:"} .x{y:z"}@import "u";.b{c:d', [([".a::before"], [("content", '"} .x{y:z"')]), ([".b"], [("c", "d")])]),
        (":is(.a, .b):focus-visible{outline:0}", [([":is(.a, .b):focus-visible"], [("outline", "0")])]), ("", []), ("}}{", [([""], [])]), ("@media", []),
    ],
)
def test_rules(css, want):
    assert list(C.rules(css)) == want


@pytest.mark.parametrize(
    ("css", "want"),
    [
        (":focus-visible{outline:2px solid}", {("universal", "*")}), ("a :focus-visible{outline:2px solid}", set()), ("*:focus-visible{outline:none}", set()), (":focus-visible{outline:none;box-shadow:0 0 1px}", {("universal", "*")}),
        (".skip:focus-visible{inset-block-start:0}", {("focus", "skip")}), (".a:focus-visible,.b:hover{border-color:red}", {("focus", "a"), ("indicator", "a")}), (".a:focus-visible{border-radius:3px}", {("focus", "a")}),
        (".a:focus-visible-not{outline:1px}", set()), ("@media print{.p .a:focus-visible{background:red}}", {("focus", "p"), ("focus", "a"), ("indicator", "p"), ("indicator", "a")}),
        (".nav ul[data-astro-cid-x]{list-style:none}", {("list-tag", "ul@data-astro-cid-x")}), ("ol{display:inline-grid}", {("list-tag", "ol@*")}), (".x ul.m, .y{list-style-type : none}", {("list-class", "m"), ("list-class", "y")}), ("ul{list-style:square}ul li{display:block}", set()), ("ulx{display:flex}", set()),
    ],
)
def test_facts(css, want):
    assert C.facts(css) == want


def found(spark, pages, **how):
    t = spark.createDataFrame(pages, "file string, html string, css string")
    pairs = spark.createDataFrame(how.pop("pairs", PAIRS), "pair string, fore string, back string, kind string")
    emitted = spark.createDataFrame([("index.html",)], "file string")
    return sorted((r["severity"], r["id"]) for r in A.audit(t, emitted, pairs, **how).collect())


def test_a_sound_site_has_no_findings(spark):
    assert found(spark, [("index.html", PAGE, FOCUS)]) == []


FAULTS = [
    (PAGE.replace("<h2>", "<h3>"), FOCUS, "headings|index.html|skipped-level"), (PAGE.replace("<footer></footer>", ""), FOCUS, "landmarks|index.html|missing-landmark"), (PAGE + "<main></main>", FOCUS, "landmarks|index.html|duplicate-landmark"),
    (PAGE + "<nav></nav>", FOCUS, "landmarks|index.html|unnamed-nav"), (PAGE + '<nav aria-label="Main"></nav>', FOCUS, "landmarks|index.html|duplicate-nav-name"), (PAGE.replace(' tabindex="-1"', ""), FOCUS, "skip-link|index.html|unfocusable:main"),
    (PAGE.replace(' id="t"', ""), FOCUS, "navigation|index.html|disclosure"), (PAGE.replace('for="t"', ""), FOCUS, "navigation|index.html|summary"), (PAGE.replace(' id="t"', ' id="t" checked'), FOCUS, "navigation|index.html|toggle-open"),
    (PAGE.replace('<a href="/">', '<a href="/gone/">'), FOCUS, "navigation|index.html|dead:/gone/"), (PAGE + '<a href="/x/" aria-current="page">x</a>', FOCUS, "navigation|index.html|current-mismatch"),
    (PAGE + '<section id="s"></section><p id="s-title">', FOCUS, "landmarks|index.html|unnamed-section:s"), (PAGE + '<section aria-labelledby="no"></section>', FOCUS, "landmarks|index.html|dangling-name:no"),
    (PAGE + '<ul class="m data-astro-cid-x" data-astro-cid-x></ul>', FOCUS + ".m{display:flex}", "lists|*|ul.m"), (PAGE + "<ol></ol>", FOCUS + "ol{list-style:none}", "lists|*|ol"),
    (PAGE, FOCUS.replace("#111}", "#eee}"), "contrast||ink-paper"), (PAGE, FOCUS.replace("snow", "nocolour"), "contrast||missing-token:ink-paper"),
]


@pytest.mark.parametrize(("html", "css", "want"), FAULTS, ids=[f[2] for f in FAULTS])
def test_one_fault(spark, html, css, want):
    got = found(spark, [("index.html", html, css)])
    assert ("error", want) in got and len([g for g in got if not g[1].endswith("unreadable-palette")]) == 1


def test_lists_that_say_they_are_lists_and_scopes(spark):
    css = FOCUS + "ul[data-astro-cid-x]{list-style:none}"
    assert found(spark, [("index.html", PAGE + '<ul role="list" data-astro-cid-x></ul><ul data-astro-cid-y></ul>', css)]) == []


def test_controls_that_no_rule_reaches_are_one_finding_a_shape(spark):
    css = FOCUS.replace(":focus-visible", ".skip:focus-visible")
    got = found(spark, [("index.html", PAGE + "<a>no control</a><button class='x'>", css), ("b/index.html", PAGE, css), ("c/index.html", PAGE, FOCUS)])
    assert got == [("error", i) for i in ("focus|*|a", "focus|*|button", "focus|b/index.html|system-rule", "focus|index.html|system-rule")]
    t = A.audit(spark.createDataFrame([(f"{i}.html", PAGE, css) for i in range(5)], "file string, html string, css string"), spark.createDataFrame([("index.html",)], "file string"), spark.createDataFrame(PAIRS, "pair string, fore string, back string, kind string"))
    assert [r["detail"] for r in t.filter("id = 'focus|*|a'").collect()] == ["a 5 pages, as 0.html"]


def test_names_that_most_pages_of_every_family_have(spark):
    other = PAGE.replace('"Main"', '"Menu"')
    pages = [(f"a/{i}/index.html", PAGE, FOCUS) for i in range(3)] + [("index.html", PAGE, FOCUS), ("b.html", PAGE + '<nav aria-label="Trail"></nav>', FOCUS), ("a/9/index.html", other, FOCUS)]
    assert found(spark, pages) == [("error", "landmarks|a/9/index.html|nav-missing:Main")]


def test_review_pages_show_no_chrome(spark):
    assert found(spark, [("review/x.html", "<h1>T</h1><main></main>", FOCUS), ("index.html", PAGE, FOCUS)], review=("review/",)) == []
    assert found(spark, [("review/x.html", PAGE, FOCUS), ("index.html", PAGE, FOCUS)], review=("review/",)) == [("error", "landmarks|review/x.html|review-footer"), ("error", "landmarks|review/x.html|review-header")]


def test_baseline_and_warnings(spark):
    b = spark.createDataFrame([("lists|*|ol", "later"), ("lists|*|ul", "old")], "id string, decision string")
    assert found(spark, [("index.html", PAGE + "<ol></ol>", FOCUS + "ol{list-style:none}")], baseline=b) == [("baseline", "lists|*|ol"), ("error", "lists|*|ul")]
    got = found(spark, [("index.html", PAGE.replace(' aria-label="Main"', ""), ":focus-visible{outline:1px solid}")])
    assert got == [("error", "landmarks|index.html|unnamed-nav"), ("warning", "contrast||no-palette"), ("warning", "navigation||vacuous")]
    assert {i for _, i in found(spark, [("x.html", None, None)])} >= {"navigation|x.html|no-nav", "focus|x.html|system-rule"}


def test_counts(spark):
    t = spark.createDataFrame([("index.html", PAGE, FOCUS), ("r/x.html", None, None)], "file string, html string, css string")
    assert tuple(A.counts(t, ("r/",)).first()) == (2, 1, 2, 2, 1)


def test_the_skip_link_is_looked_for_once_a_page(spark, capsys):
    pages = spark.createDataFrame([("a", "<p>x</p>", "")], "file string, html string, css string")
    A.read(pages).select("skip").explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("bskip[a-z-]*") == 1
