"""The accessibility audit: outlines, landmarks, names, navigation, focus, lists, skip links and contrast of a built site.

Pages are read once, in a projection that keeps what the rules ask: elements with their classes, landmarks with their names, levels. Style
sheets are tokenized once each, and their index of classes meets the pages by sheet, salted, as all pages of a site may apply one. An omission
on many pages is one finding a shape (tag and classes), with the number of pages and one of them as example, never a list of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from . import css as C
from . import gates as G
from . import identity as I
from . import ordering as W
from .lineage import cut

SALTS = 16
GATE = "accessibility"
# Landmarks that pages with and without site chrome need, and elements that take focus by themselves.
SITE, REVIEW = ("header", "main", "footer"), ("main",)
FOCUSABLE = ("a", "button", "input", "select", "textarea", "summary", "iframe")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a double-quoted attribute; empty without it."""
    return F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1)


def classes(tag: Column) -> Column:
    """Classes of a tag, scope marks left out."""
    return F.filter(F.split(_attribute(tag, "class"), r"\s+", -1), lambda c: (c != "") & ~c.startswith("data-astro-cid"))


def elements(html: Column, names: str) -> Column:
    """array of struct(tag, classes, shape, scopes, role, linked) of start tags of these names (alternatives)."""

    def of(t: Column) -> Column:
        tag, own = F.regexp_extract(t, "^[a-z]+", 0), classes(t)
        return F.struct(
            tag.alias("tag"), own.alias("classes"), F.array_join(F.concat(F.array(tag), own), ".").alias("shape"), F.regexp_extract_all(t, F.lit(r"\b(data-astro-cid-[A-Za-z0-9_-]+)"), 1).alias("scopes"),
            _attribute(t, "role").alias("role"), t.rlike(r"\shref=").alias("linked"),
        )

    return F.transform(H.all_of(html, rf"<((?:{names})\b[^>]*)>"), of)


def landmarks(html: Column) -> Column:
    """array of struct(tag, label); label is null without an aria-label."""
    tags = H.all_of(html, r"<((?:header|nav|main|footer)(?:\s[^>]*)?)>")
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, "^[a-z]+", 0).alias("tag"), F.when(t.contains('aria-label="'), _attribute(t, "aria-label")).alias("label")))


def read(pages: DataFrame, review: tuple[str, ...] = ()) -> DataFrame:
    """What the rules ask of pages (file, html, css); review: prefixes of files that show no site chrome."""
    h = F.coalesce("html", F.lit(""))
    own = F.lit(False)
    for p in review:
        own = own | F.col("file").startswith(p)
    skip = F.regexp_extract(h, r'<a[^>]*class="[^"]*\bskip[a-z-]*\b[^"]*"[^>]*href="#([^"]+)"', 1)
    tags = H.all_of(h, r"<([a-z0-9]+\b[^>]*)>")
    # each computed once: within a filter, a text searched for the link's name would be searched again for every tag
    target = lambda name: F.get(F.filter(tags, lambda t: t.contains(name)), F.lit(0))
    aim = lambda s, t: F.struct(s.alias("id"), F.regexp_extract(t, "^[a-z0-9]+", 0).alias("tag"), t.contains('tabindex="').alias("tab"))
    toggle = F.get(F.filter(H.all_of(h, r"<(input\b[^>]*)>"), lambda t: t.contains('type="checkbox"') & t.rlike(r'\sid="[^"]+"')), F.lit(0))
    nav = F.array_join(H.all_of(h, r"(?s)<nav\b[^>]*>(.*?)</nav>"), "\n")
    return pages.select(
        "file", own.alias("review"), F.md5(F.coalesce("css", F.lit(""))).alias("sheet"), H.heading_levels(h).alias("levels"), landmarks(h).alias("marks"),
        F.filter(elements(h, "a|button|summary"), lambda e: (e["tag"] != "a") | e["linked"]).alias("controls"), elements(h, "ul|ol").alias("lists"),
        H.let(skip, lambda s: F.when(s != "", H.let(F.concat(F.lit(' id="'), s, F.lit('"')), lambda name: H.let(target(name), lambda t: aim(s, t))))).alias("skip"),
        H.let(toggle, lambda t: F.when(t.isNotNull(), F.struct(h.contains(F.concat(F.lit('for="'), _attribute(t, "id"), F.lit('"'))).alias("label"), t.rlike(r"\bchecked\b").alias("checked")))).alias("toggle"),
        F.transform(F.filter(H.all_of(h, r"<(a\b[^>]*)>"), lambda t: t.contains('aria-current="page"')), lambda t: _attribute(t, "href")).alias("current"),
        F.transform(H.all_of(nav, r"<(a\b[^>]*)>"), lambda t: _attribute(t, "href")).alias("nav_links"),
    )


def route_file(href: Column) -> Column:
    """The file that a link of the site names."""
    clean = F.regexp_replace(U.path_part(href), "^/", "")
    return F.when(clean == "", "index.html").when(clean.endswith(".html"), clean).otherwise(F.concat(F.regexp_replace(clean, "/$", ""), F.lit("/index.html")))


def _say(check: str, key: Column | str) -> Column:
    return F.struct(F.lit(check).alias("check"), (F.lit(key) if isinstance(key, str) else key).alias("key"))


def page_findings(facts: DataFrame) -> DataFrame:
    """at, check, key of what a page shows by itself: landmarks, skip links, the menu's toggle and current marks."""
    navs = F.filter("marks", lambda m: m["tag"] == "nav")
    count = lambda tag: F.size(F.filter("marks", lambda m: m["tag"] == tag))
    names = F.filter(F.transform(navs, lambda m: m["label"]), lambda n: n.isNotNull())
    site = [F.when(~F.col("review") & (count(t) == 0), _say("landmarks", "missing-landmark")) for t in SITE if t != "main"]
    chrome = [F.when(F.col("review") & (count(t) > 0), _say("landmarks", f"review-{t}")) for t in SITE if t != "main"]
    production = ~F.col("review")
    has_nav = production & (F.size(navs) > 0)
    skip = F.col("skip")
    own = F.array_compact(F.array(
        *site, *chrome, F.when(count("main") == 0, _say("landmarks", "missing-landmark")), F.when(count("main") > 1, _say("landmarks", "duplicate-landmark")),
        F.when(F.exists(navs, lambda m: F.trim(F.coalesce(m["label"], F.lit(""))) == ""), _say("landmarks", "unnamed-nav")), F.when(F.size(F.array_distinct(names)) < F.size(names), _say("landmarks", "duplicate-nav-name")),
        F.when(skip.isNotNull() & (skip["tag"] != "") & ~skip["tag"].isin(*FOCUSABLE) & ~skip["tab"], _say("skip-link", F.concat(F.lit("unfocusable:"), skip["id"]))),
        F.when(production & (F.size(navs) == 0), _say("navigation", "no-nav")), F.when(has_nav & F.col("toggle").isNull(), _say("navigation", "disclosure")),
        F.when(has_nav & ~F.col("toggle.label"), _say("navigation", "summary")), F.when(has_nav & F.col("toggle.checked"), _say("navigation", "toggle-open")),
    ))
    wrong = F.when(has_nav, F.filter("current", lambda h: (h != "") & (route_file(h) != F.col("file"))))
    every = F.concat(own, F.transform(F.coalesce(wrong, F.array().cast("array<string>")), lambda h: _say("navigation", "current-mismatch")))
    # outer: the planner would else ask for a size first, and compute all of it twice
    return facts.select(F.col("file").alias("at"), F.explode_outer(every).alias("f")).filter("f is not null").select("at", "f.check", "f.key")


def dead_navigation(facts: DataFrame, emitted: DataFrame) -> DataFrame:
    """at, check, key of menu links to files that the build did not emit. emitted: file."""
    links = facts.filter(~F.col("review")).select(F.col("file").alias("at"), F.explode(F.array_distinct("nav_links")).alias("href"))
    links = links.filter((F.col("href") != "") & ~F.col("href").rlike("^(https?:|mailto:|tel:|#)")).withColumn("file", route_file(F.col("href")))
    return links.join(emitted.select("file").distinct(), "file", "left_anti").select("at", F.lit("navigation").alias("check"), F.concat(F.lit("dead:"), "href").alias("key"))


def chrome_findings(facts: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """at, check, key of pages that lack a nav name which most pages of every family have. families: file, family; else by the path."""
    t = facts.filter(~F.col("review")).select("file", F.array_distinct(F.transform(F.filter("marks", lambda m: m["tag"] == "nav"), lambda m: F.coalesce(m["label"], F.lit("(unnamed)")))).alias("names"))
    if families is not None:
        t = t.join(families.select("file", F.col("family").alias("f_")), "file", "left").withColumn("family", F.coalesce("f_", U.template_family(F.col("file")))).drop("f_")
    else:
        t = t.withColumn("family", U.template_family(F.col("file")))
    each = t.select("family", "file", F.explode_outer("names").alias("name"))
    chrome = W.majority_then_all(each, "family", "file", "name").agg(F.collect_set("name").alias("chrome"))  # names on most pages: about as many as a page has
    lost = t.crossJoin(F.broadcast(chrome)).select("file", F.explode(F.array_except("chrome", "names")).alias("name"))  # one row
    return lost.select(F.col("file").alias("at"), F.lit("landmarks").alias("check"), F.concat(F.lit("nav-missing:"), "name").alias("key"))


def style_findings(facts: DataFrame, index: DataFrame) -> DataFrame:
    """at, check, key, detail of focus and lists. A page without the universal focus rule is one finding; controls that no drawing rule reaches and
    lists that lost their semantics are one finding a shape."""
    kinds = {"universal": "universal", "indicator": "indicator", "list-class": "list_class", "list-tag": "list_tag"}
    held = index.groupBy("sheet").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("name"))).alias(v) for k, v in kinds.items()])  # of one sheet
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    t = facts.select("file", "sheet", "controls", "lists").withColumn("salt", F.pmod(F.hash("file"), F.lit(SALTS))).join(held, ["sheet", "salt"], "left")
    none = F.array().cast("array<string>")
    t = t.select("file", (F.size(F.coalesce("universal", none)) > 0).alias("universal"), "controls", "lists", *[F.coalesce(c, none).alias(c) for c in ("indicator", "list_class", "list_tag")])
    bare = F.when(~F.col("universal"), F.filter("controls", lambda e: ~F.arrays_overlap(e["classes"], F.col("indicator"))))
    scoped = lambda e: F.transform(F.concat(F.array(F.lit("*")), e["scopes"]), lambda s: F.concat(e["tag"], F.lit("@"), s))
    stripped = F.filter("lists", lambda e: (F.arrays_overlap(e["classes"], F.col("list_class")) | F.arrays_overlap(scoped(e), F.col("list_tag"))) & ~e["role"].eqNullSafe("list"))
    shapes = lambda xs, check: F.transform(F.array_distinct(F.transform(F.coalesce(xs, F.slice("controls", 1, 0)), lambda e: e["shape"])), lambda s: _say(check, s))
    every = t.select("file", F.explode(F.concat(shapes(bare, "focus"), shapes(stripped, "lists"))).alias("f"))
    found = every.groupBy("f.check", "f.key").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"))
    found = found.select(F.lit("*").alias("at"), "check", "key", F.concat_ws(" ", F.col("n").cast("string"), F.lit("pages, as"), "first").alias("detail"))
    lacking = t.filter(~F.col("universal")).select(F.col("file").alias("at"), F.lit("focus").alias("check"), F.lit("system-rule").alias("key"), F.lit("").alias("detail"))
    return found.unionByName(lacking)


def contrast_findings(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """at, check, key, detail, severity of colour pairs (pair, fore, back, kind) against the palette that the pages' styles ship. Sheets follow each
    other by their first page; no palette at all is a warning."""
    css = F.coalesce("css", F.lit(""))
    first = pages.select("file", F.md5(css).alias("sheet"), css.alias("css")).groupBy("sheet").agg(F.min("file").alias("file"), F.first("css").alias("css"))
    pat = r"(--color-[a-z0-9-]+\s*:[^;}]+[;}])"
    declared = first.select("file", F.array_join(H.all_of(F.col("css"), pat), " ").alias("css")).filter("css <> ''")
    # one short text of declarations: a palette is a site's configuration
    whole = declared.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "css"))), lambda x: x["css"]), " ").alias("css"))
    known, unread = G.palette(whole)
    known = cut(known)
    row = lambda d, key, detail, severity="error": d.select(F.lit("").alias("at"), F.lit("contrast").alias("check"), key.alias("key"), detail.alias("detail"), F.lit(severity).alias("severity"))
    odd = row(unread, F.lit("unreadable-palette"), F.concat_ws(": ", "token", "value"))
    if known.isEmpty():
        one = pages.sparkSession.range(1)
        return odd if not unread.isEmpty() else row(one, F.lit("no-palette"), F.lit(""), "warning")
    judged = G.contrast_failures(pairs, known).filter("state <> 'ok'")
    key = F.when(F.col("state") == "low", F.col("pair")).otherwise(F.concat(F.lit("missing-token:"), "pair"))
    return odd.unionByName(row(judged, key, F.when(F.col("state") == "low", F.col("ratio").cast("string")).otherwise("")))


def audit(pages: DataFrame, emitted: DataFrame, pairs: DataFrame, families: DataFrame | None = None, review: tuple[str, ...] = (), baseline: DataFrame | None = None) -> DataFrame:
    """gate, check, severity, at, detail, id of every finding; id is check|at|key. pages: file, html, css; emitted: file; pairs: pair, fore, back, kind;
    baseline: id, decision: known findings become baseline, records that no finding has become errors.

    Null html and css are empty. A build in which no nav has a name gets a warning, as the navigation rules then looked at nothing.
    """
    facts = cut(read(pages, review))
    none = F.lit("").alias("detail")
    outline = W.outline_issues(facts, "levels", "file").select(F.col("file").alias("at"), F.lit("headings").alias("check"), F.col("code").alias("key"), "detail")
    plain = [page_findings(facts), dead_navigation(facts, emitted), chrome_findings(facts, families)]
    names = G.section_naming(pages.filter("html is not null"), "file", "html").select(F.col("file").alias("at"), F.lit("landmarks").alias("check"), F.concat_ws(":", "code", "detail").alias("key"))
    out = outline.unionByName(style_findings(facts, C.index(C.sheets_of(pages))))
    for d in (*plain, names):
        out = out.unionByName(d.select("at", "check", "key", none))
    out = out.withColumn("severity", F.lit("error")).unionByName(contrast_findings(pages, pairs))
    if facts.filter(F.exists("marks", lambda m: (m["tag"] == "nav") & m["label"].isNotNull())).isEmpty():
        out = out.unionByName(pages.sparkSession.createDataFrame([("", "navigation", "vacuous", "", "warning")], "at string, check string, key string, detail string, severity string"))
    out = out.select(F.lit(GATE).alias("gate"), "check", "severity", "at", F.concat_ws(" ", "key", F.nullif(F.col("detail"), F.lit(""))).alias("detail"), F.concat_ws("|", "check", "at", "key").alias("id"))
    if baseline is None:
        return out
    out = cut(out)
    judged = I.apply_baseline(out.filter("severity = 'error'").select("id", "severity").distinct(), baseline)
    kept = out.filter("severity <> 'error'")
    hit = out.filter("severity = 'error'").drop("severity").join(judged.select("id", "severity"), "id")
    stale = judged.join(out.select("id"), "id", "left_anti").select(F.lit(GATE).alias("gate"), F.split("id", "[|]")[0].alias("check"), F.lit("error").alias("severity"), F.split("id", "[|]")[1].alias("at"), F.concat(F.lit("stale:"), F.split("id", "[|]")[2]).alias("detail"), "id")
    return kept.unionByName(hit).unionByName(stale)


def counts(pages: DataFrame, review: tuple[str, ...] = ()) -> DataFrame:
    """One row: how much an audit looked at."""
    t = read(pages, review)
    return t.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("review")).alias("review_pages"), F.sum(F.size("levels")).alias("headings"), F.sum(F.size("controls")).alias("controls"), F.sum(F.size(F.filter("marks", lambda m: m["tag"] == "nav"))).alias("navs"))
