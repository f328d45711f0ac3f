"""Gates: audits that compose operators and end in one findings frame (gate, check, severity, at, detail, id)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import html as H
from ..functions import url as U
from . import css as S
from . import identity as I
from . import inventory as V
from . import ordering as W

# The colour names that a palette may use.
COLOURS = {
    "azure": "#f0ffff", "beige": "#f5f5dc", "bisque": "#ffe4c4", "brown": "#a52a2a", "coral": "#ff7f50", "gold": "#ffd700", "gray": "#808080", "green": "#008000", "indigo": "#4b0082", "ivory": "#fffff0", "khaki": "#f0e68c", "linen": "#faf0e6",
    "maroon": "#800000", "navy": "#000080", "olive": "#808000", "orange": "#ffa500", "orchid": "#da70d6", "peru": "#cd853f", "pink": "#ffc0cb", "plum": "#dda0dd", "purple": "#800080", "red": "#ff0000", "salmon": "#fa8072", "sienna": "#a0522d",
    "silver": "#c0c0c0", "snow": "#fffafa", "tan": "#d2b48c", "teal": "#008080", "tomato": "#ff6347", "violet": "#ee82ee", "wheat": "#f5deb3",
}
# Contrast that text, large text and controls need.
THRESHOLDS = {"text": 4.5, "large": 3.0, "control": 3.0}


def finding(df: DataFrame, gate: str, check: str, severity: str, at: Column, detail: Column | None = None) -> DataFrame:
    d = F.lit("") if detail is None else detail.cast("string")
    t = df.select(F.lit(gate).alias("gate"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), at.cast("string").alias("at"), d.alias("detail"))
    return t.withColumn("id", F.concat_ws("|", "check", "at", "detail"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def palette(css: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, hex) of --color-* declarations, and the (token, value) that are neither hex nor a known name."""
    pat = r"--color-([a-z0-9-]+)\s*:\s*([^;}]+?)\s*[;}]"
    z = F.arrays_zip(F.regexp_extract_all("css", F.lit(pat), 1).alias("t"), F.regexp_extract_all("css", F.lit(pat), 2).alias("v"))
    t = css.select(F.posexplode(z).alias("pos", "z")).select("pos", F.col("z.t").alias("token"), F.lower("z.v").alias("value"))
    names = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    t = t.withColumn("hex", F.when(F.col("value").startswith("#"), F.col("value")).otherwise(F.try_element_at(names, F.col("value"))))
    good = C.channel(F.col("hex"), 0).isNotNull()
    return I.last_wins(t.filter(good).select("token", "hex", "pos"), "token", "pos").select("token", "hex"), t.filter(F.coalesce(~good, F.lit(True))).select("token", "value")


def contrast_failures(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """pair, state (ok, low, missing-token), ratio. pairs: pair, fore, back, kind."""
    a, b = colours.select(F.col("token").alias("fore"), F.col("hex").alias("f")), colours.select(F.col("token").alias("back"), F.col("hex").alias("b"))
    t = pairs.join(F.broadcast(a), "fore", "left").join(F.broadcast(b), "back", "left").withColumn("ratio", C.contrast(F.col("f"), F.col("b")))
    need = F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), F.col("kind"))
    return t.select("pair", F.when(F.col("f").isNull() | F.col("b").isNull(), "missing-token").when(F.col("ratio") < need, "low").otherwise("ok").alias("state"), "ratio")


def focus_classes(css: Column) -> Column:
    """Classes whose :focus-visible rule draws something."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted(n for k, n in S.facts(x or "") if k == "indicator"))

    return run(css)


def has_universal_focus(css: Column) -> Column:
    """Is there a :focus-visible rule for everything that draws something?"""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: ("universal", "*") in S.facts(x or ""))

    return run(css)


def section_naming(pages: DataFrame, at: str, html: str) -> DataFrame:
    """at, code, detail: sections named by an id that the page lacks, and sections that do not point at their own title."""
    h = F.col(html)
    ids = F.regexp_extract_all(h, F.lit(r'\sid="([^"]+)"'), 1)
    secs = F.transform(F.regexp_extract_all(h, F.lit(r"<section\b([^>]*)>"), 1), lambda a: F.struct(F.regexp_extract(a, r'\sid="([^"]+)"', 1).alias("id"), F.regexp_extract(a, r'\saria-labelledby="([^"]+)"', 1).alias("by")))
    t = pages.select(at, ids.alias("ids"), F.explode(secs).alias("s")).select(at, "ids", "s.id", "s.by")
    dangling = t.filter((F.col("by") != "") & ~F.array_contains("ids", F.col("by"))).select(at, F.lit("dangling-name").alias("code"), F.col("by").alias("detail"))
    own = F.concat(F.col("id"), F.lit("-title"))
    return dangling.unionByName(t.filter((F.col("id") != "") & F.array_contains("ids", own) & (F.col("by") != own)).select(at, F.lit("unnamed-section").alias("code"), F.col("id").alias("detail")))


def navigation(pages: DataFrame, at: str, html: str, files: DataFrame) -> DataFrame:
    """at, code, detail: pages without a nav, nav links to no file, current marks on other pages. files: file; at is the page's file."""
    nav = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav>"), 1), "\n")
    t = pages.select(at, nav.alias("nav"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<nav\b)"), 1)).alias("n"))
    none = t.filter("n = 0").select(at, F.lit("no-nav").alias("code"), F.lit("").alias("detail"))
    links = t.select(at, F.explode(F.regexp_extract_all("nav", F.lit(r"(?i)(<a\b[^>]*>)"), 1)).alias("a")).select(at, "a", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href")).filter(F.col("href").startswith("/"))
    links = links.withColumn("to_", U.page_file(U.path_part(F.col("href"))))
    lost = links.join(files.select(F.col("file").alias("to_")), "to_", "left_anti").select(at, F.lit("dead-nav-link").alias("code"), F.col("href").alias("detail"))
    wrong = links.filter(F.col("a").contains('aria-current="page"') & (F.col("to_") != F.col(at))).select(at, F.lit("wrong-current").alias("code"), F.col("href").alias("detail"))
    return none.unionByName(lost).unionByName(wrong)


def accessibility(pages: DataFrame, files: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Findings over outline, landmarks, naming, navigation and focus. pages: file, html, css. A baseline marks known ones and reports stale ones."""
    g = "accessibility"
    t = pages.withColumn("levels", H.heading_levels(F.col("html"))).withColumn("marks", H.landmarks(F.col("html")))
    o = W.outline_issues(t, "levels", "file")
    out = union([
        finding(o, g, "headings", "error", F.col("file"), F.concat_ws(":", "code", "detail")),
        finding(t.filter(~F.array_contains("marks", "main")), g, "landmarks", "error", F.col("file"), F.lit("no-main")),
        finding(section_naming(pages, "file", "html"), g, "landmarks", "error", F.col("file"), F.concat_ws(":", "code", "detail")),
        finding(navigation(pages, "file", "html", files), g, "navigation", "error", F.col("file"), F.concat_ws(":", "code", "detail")),
        finding(pages.filter(~has_universal_focus(F.col("css"))), g, "focus", "error", F.col("file"), F.lit("system-rule")),
    ])
    if baseline is None:
        return out
    judged = I.apply_baseline(out.select("id", "severity").distinct(), baseline)
    return out.drop("severity").join(judged.select("id", "severity"), "id", "right").select("gate", "check", "severity", "at", "detail", "id")


def preview(output: DataFrame, routes: DataFrame) -> DataFrame:
    """Findings over a built artifact: promised files, internal links, base elements. output: file, bytes, text; routes: file. No routes is
    one error, not silence."""
    g = "preview"
    if routes.isEmpty():
        return finding(output.sparkSession.range(1), g, "manifest", "error", F.lit("manifest"), F.lit("missing"))
    html = output.filter(F.col("file").endswith(".html"))
    refs = html.select(F.col("file").alias("page_id"), F.explode(H.link_references(F.col("text"))).alias("r")).select("page_id", "r.tag", "r.raw")
    checks = V.route_checks(routes.select("file"), output.select("file", "bytes"))
    return union([
        finding(checks, g, "routes", "error", F.col("file"), F.col("code")), finding(V.broken_links(refs, output.select("file")), g, "links", "error", F.col("page_id"), F.col("raw")),
        finding(html.filter(H.declares_base(F.col("text"))), g, "base", "error", F.col("file")), finding(html.filter(H.inline_handlers(F.col("text")) > 0), g, "scripts", "error", F.col("file"), F.lit("inline-handler")),
    ])


def markdown(headings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings over document outlines. headings: file, line, level, heading, anchor; files: file."""
    from pyspark.sql import Window

    g = "docs"
    w = Window.partitionBy("file").orderBy("line")
    t = headings.withColumn("p", F.lag("level").over(w)).withColumn("i", F.row_number().over(w)).withColumn("ones", F.sum((F.col("level") == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = headings.groupBy("file").agg(F.min_by("level", "line").alias("first"), F.count_if(F.col("level") == 1).alias("ones"), F.min("line").alias("line"))
    return union([
        finding(files.select("file").join(headings.select("file"), "file", "left_anti"), g, "heading-none", "error", F.col("file")),
        finding(first.filter("ones = 0"), g, "heading-no-h1", "error", F.col("file"), F.col("line")), finding(first.filter("ones > 0 and first <> 1"), g, "heading-h1-not-first", "error", F.col("file"), F.col("line")),
        finding(t.filter("level = 1 and ones > 1"), g, "heading-multiple-h1", "warning", F.col("file"), F.col("line")), finding(t.filter("level > p + 1"), g, "heading-level-skip", "warning", F.col("file"), F.col("line")),
        finding(t.filter("heading = ''"), g, "heading-empty", "error", F.col("file"), F.col("line")), finding(t.filter("heading <> '' and anchor = ''"), g, "heading-unaddressable", "error", F.col("file"), F.col("line")),
    ])


def metadata(lines: DataFrame) -> DataFrame:
    """file, code of the **Field:** block after a title: required fields, known status, a real date. lines: file, line, text, fenced."""
    from .rules import findings

    plain = lines.filter(~F.col("fenced")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("x")))).alias("l"))
    said = F.filter(F.transform("l", lambda s: s["x"]), lambda x: x != "")
    first, rest = F.get(said, F.lit(0)), F.slice(said, F.lit(2), F.greatest(F.size(said), F.lit(0)))
    # a field is bold up to its colon: **Name:** value
    name = lambda x: F.substring_index(F.substring(x, 3, 1 << 30), ":**", 1)
    held = lambda x: F.ltrim(F.substring(x, F.length(name(x)) + 6, F.lit(1 << 30)))
    is_field = lambda x: x.startswith("**") & x.contains(":**") & (name(x) != "") & ~name(x).contains("*") & ~name(x).contains(":")
    # the run of fields directly after the title
    run = F.aggregate(rest, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("f")), lambda s, x: F.struct((s["on"] & is_field(x)).alias("on"), F.when(s["on"] & is_field(x), F.concat(s["f"], F.array(x))).otherwise(s["f"]).alias("f")), lambda s: s["f"])
    t = plain.select("file", first.alias("title"), run.alias("f"))
    value = lambda n: F.get(F.transform(F.filter("f", lambda x: name(x) == n), held), F.lit(0))
    t = t.select("file", "title", F.size("f").alias("n"), *[value(n).alias(a) for n, a in (("Status", "status"), ("Owner", "owner"), ("Last updated", "updated"), ("Phase", "phase"))])
    has = F.col("n") > 0
    return findings(t, "file", [
        ("meta-title", ~F.col("title").rlike(r"^#\s+\S")), ("meta-block-missing", ~has), *[(f"meta-{a}-missing", has & F.col(a).isNull()) for a in ("status", "owner", "updated", "phase")],
        ("meta-bad-status", has & F.col("status").isNotNull() & ~F.col("status").isin("Draft", "In Review", "Approved")),
        ("meta-bad-date", has & F.col("updated").isNotNull() & (~F.col("updated").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp("updated", F.lit("yyyy-MM-dd")).isNull())),
    ])


def release(checks: DataFrame) -> DataFrame:
    """verdict and counts of checks (id, state: pass, fail, review or not-evaluated). Not evaluated is not passed."""
    s = F.col("state")
    n = [F.count_if(s == x).alias(x.replace("-", "_")) for x in ("pass", "fail", "review", "not-evaluated")]
    t = checks.agg(*n, F.array_join(F.array_sort(F.collect_list(F.when(s == "fail", F.col("id")))), ",").alias("blocking"))
    return t.withColumn("verdict", F.when(F.col("fail") > 0, "blocked").when(F.col("review") + F.col("not_evaluated") > 0, "unresolved").when(F.col("pass") == 0, "unresolved").otherwise("ready"))


def prepared_body(html: str, hosts: tuple[str, ...], away: tuple[str, ...], to_local) -> str:
    """A migrated body: references rewritten, own links made internal, images deferred, level-1 headings demoted."""
    import re

    from .dom import internalised, rewritten

    html = internalised(rewritten(html, to_local), hosts, away)
    html = re.sub(r"<img(?![^>]*\bloading=)", '<img loading="lazy" decoding="async"', html)
    return re.sub(r"(?i)(</?)h1\b", r"\1h2", html)


def media_conflicts(found: DataFrame) -> DataFrame:
    """key, hosts: keys that more than one host serves; references without a host never conflict. found: key, host."""
    t = found.filter("key is not null and host <> ''").groupBy("key").agg(F.countDistinct("host").alias("n"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))
    return t.filter("n > 1").select("key", "hosts")
