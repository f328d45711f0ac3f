"""The SEO audit: titles, descriptions, social tags, canonicals, robots, structured data and heads of built pages.

A head is read once into a map of its tags, the last of a name wins. Structured data is parsed to VARIANT, block by block, and judged by what the
JSON holds. A title that is too long is an error where the site wrote it and a warning where the manifest says that content brought it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import site as S
from ..functions.text import squash_ends
from .lineage import cut

GATE = "seo"
# Budgets, the social tags a page must have, the context of structured data.
TITLE_MOST, DESCRIPTION_LEAST, DESCRIPTION_MOST = 60, 50, 160
SOCIAL = ("og:title", "og:type", "og:site_name", "og:locale", "twitter:card", "twitter:title")
CONTEXT = "https://schema.org"
LARGE = "summary_large_image"
ESCAPES = {"<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def decoded(s: Column) -> Column:
    """An attribute's value without its escapes; the ampersand's last, so that nothing is decoded twice."""
    for plain, spelled in ESCAPES.items():
        s = F.replace(s, F.lit(spelled), F.lit(plain))
    return F.replace(s, F.lit("&amp;"), F.lit("&"))


def units(s: Column) -> Column:
    """Length in UTF-16 units, as browsers count."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _attribute(tag: Column, name: str) -> Column:
    return F.when(tag.rlike(rf'\s{name}="[^"]*"'), F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1))


def _head(html: Column) -> Column:
    return F.when(html.contains("</head>"), F.substring_index(html, "</head>", 1)).otherwise("")


def head_map(html: Column) -> Column:
    """map of a head's meta tags, by name or else property; the last one wins; tags without a name or content are none."""
    tags = F.transform(H.all_of(_head(html), r"<meta\b([^>]*)>"), lambda t: F.struct(F.coalesce(_attribute(t, "name"), _attribute(t, "property")).alias("k"), decoded(_attribute(t, "content")).alias("v")))
    good = F.filter(tags, lambda t: t["k"].isNotNull() & t["v"].isNotNull())
    return H.let(good, lambda g: H.let(F.array_distinct(F.transform(g, lambda t: t["k"])), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(g, lambda t: t["k"] == k), -1)["v"]))))


def title_of(html: Column) -> Column:
    return F.when(html.rlike(r"(?s)<title>.*?</title>"), squash_ends(decoded(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))))


def canonicals(html: Column) -> Column:
    tags = F.filter(H.all_of(_head(html), r"<(link\b[^>]*)>"), lambda t: t.contains('rel="canonical"'))
    return F.array_compact(F.transform(tags, lambda t: decoded(_attribute(t, "href"))))


def heads(pages: DataFrame) -> DataFrame:
    """file, title, tags (map), n_descriptions, canonicals, lang, blocks (structured data) of pages (file, html)."""
    h = F.coalesce("html", F.lit(""))
    return pages.select(
        "file", title_of(h).alias("title"), head_map(h).alias("tags"), F.size(F.filter(H.all_of(_head(h), r"<(meta\b[^>]*)>"), lambda t: t.contains('name="description"'))).alias("n_descriptions"), canonicals(h).alias("canonicals"),
        F.nullif(F.trim(F.regexp_extract(h, r'<html\b[^>]*\slang="([^"]*)"', 1)), F.lit("")).alias("lang"), H.all_of(h, r'(?s)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>').alias("blocks"),
    )


def _absolute(url: Column) -> Column:
    return url.startswith("//") | url.rlike("(?i)^[a-z][a-z0-9+.-]*://")


def page_path(file: Column) -> Column:
    return F.when(file == "index.html", "/").when(file == "404.html", "/404").otherwise(F.concat(F.lit("/"), F.regexp_replace(file, "/index[.]html$", "")))


def _say(check: str, key: Column | str, severity: Column | str = "error") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(check).alias("check"), lit(key).alias("key"), lit(severity).alias("severity"))


def page_findings(t: DataFrame, origin: str | None, environment: str) -> DataFrame:
    """at, check, key, severity of what one page's head breaks. t: heads with family (or null) and review."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    title, words, canon = F.col("title"), tag("description"), F.get("canonicals", F.lit(0))
    bare = F.coalesce(F.trim(words), F.lit("")) == ""
    site = ~F.col("review")
    static = F.coalesce("family", F.lit("static")) == "static"
    relative = lambda k: F.when(site & tag(k).isNotNull() & ~_absolute(tag(k)), _say("social", f"relative:{k}"))
    n = F.size("canonicals")
    if origin is None:
        chosen = F.when(n > 1, _say("canonical", "multiple")).when(n == 1, _say("canonical", "premature"))
    else:
        root = origin.rstrip("/") + "/"
        chosen = F.when(n > 1, _say("canonical", "multiple")).when(~site, None).when(n == 0, _say("canonical", "missing")).when(~_absolute(canon), _say("canonical", "relative")).when(~canon.startswith(root), _say("canonical", "foreign"))
    every = F.array_compact(F.array(
        F.when(F.coalesce(title, F.lit("")) == "", _say("title", "missing")), F.when(units(title) > TITLE_MOST, _say("title", "too-long", F.when(static, "error").otherwise("warning"))),
        F.when(F.col("n_descriptions") > 1, _say("description", "duplicated-tag")), F.when(bare, _say("description", "missing")), F.when(~bare & (units(words) > DESCRIPTION_MOST), _say("description", "too-long")),
        F.when(~bare & (units(words) < DESCRIPTION_LEAST), _say("description", "too-short")), F.when(~bare & (F.trim(words) == title), _say("description", "repeats-title")),
        *[F.when(site & (F.coalesce(F.trim(tag(k)), F.lit("")) == ""), _say("social", f"missing:{k}")) for k in SOCIAL],
        F.when(site & (tag("og:title") != title), _say("social", "og-title-drift")), F.when(site & (tag("og:description") != words), _say("social", "og-description-drift")),
        F.when(site & (tag("twitter:card") == LARGE) & tag("og:image").isNull(), _say("social", "card-without-image")), relative("og:url"), relative("og:image"), chosen,
        F.when(F.trim(F.coalesce(tag("robots"), F.lit(""))) != S.robots_directive(page_path(F.col("file")), F.lit(environment)), _say("robots", "robots")),
        F.when(F.col("lang").isNull(), _say("head", "no-lang")), F.when(tag("viewport").isNull(), _say("head", "no-viewport")), F.when(tag("keywords").isNotNull(), _say("head", "keywords", "warning")),
    ))
    return t.select(F.col("file").alias("at"), F.explode_outer(every).alias("f")).filter("f is not null").select("at", "f.check", "f.key", "f.severity")


def structured_findings(t: DataFrame) -> DataFrame:
    """at, check, key, severity of structured data: blocks that are no JSON, of another context, or without a type of their own or of all nodes
    of their graph. Blocks are numbered from 0."""
    b = t.select("file", F.posexplode("blocks").alias("i", "text")).select("file", "i", F.try_parse_json("text").alias("v"))
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    typed = lambda v: F.coalesce(text(v, '$["@type"]') != "", F.lit(False))
    nodes = F.try_variant_get("v", '$["@graph"]', "array<variant>")
    graph = F.coalesce((F.size(nodes) > 0) & F.forall(nodes, typed), F.lit(False))
    say = lambda code: _say("structured-data", F.concat(F.lit(f"{code}:"), F.col("i").cast("string")))
    whole = F.col("v").isNotNull()
    every = F.array_compact(F.array(
        F.when(~whole, say("invalid-json")), F.when(whole & ~text(F.col("v"), '$["@context"]').eqNullSafe(F.lit(CONTEXT)), say("context")), F.when(whole & ~typed(F.col("v")) & ~graph, say("type")),
    ))
    return b.select(F.col("file").alias("at"), F.explode_outer(every).alias("f")).filter("f is not null").select("at", "f.check", "f.key", "f.severity")


def shared_findings(t: DataFrame) -> DataFrame:
    """at, check, key, severity of titles and descriptions that pages share: one finding a text, at its first page."""
    words = F.try_element_at("tags", F.lit("description"))
    out = None
    for check, value, key in (("title", F.col("title"), F.col("value")), ("description", F.when(F.trim(words) != "", words), F.substring("value", 1, 40))):
        g = t.select("file", value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("at")).filter("n > 1")
        g = g.select("at", F.lit(check).alias("check"), F.concat(F.lit("duplicate:"), key).alias("key"), F.lit("error").alias("severity"))
        out = g if out is None else out.unionByName(g)
    return out


def audit(pages: DataFrame, origin: str | None, environment: str = "preview", families: DataFrame | None = None, review: tuple[str, ...] = ()) -> DataFrame:
    """gate, check, severity, at, key, id of every finding. pages: file, html; families: file, family (what the manifest says a page comes from; static
    pages are the site's own); review: prefixes of files that are not for the public. Null html is an empty page."""
    own = F.lit(False)
    for p in review:
        own = own | F.col("file").startswith(p)
    t = cut(heads(pages)).withColumn("review", own)
    t = t.join(families.select("file", "family"), "file", "left") if families is not None else t.withColumn("family", F.lit(None).cast("string"))
    out = page_findings(t, origin, environment).unionByName(structured_findings(t)).unionByName(shared_findings(t))
    return out.select(F.lit(GATE).alias("gate"), "check", "severity", "at", "key", F.concat_ws("|", "check", "at", "key").alias("id"))
