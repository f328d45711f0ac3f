"""Columns that take HTML apart by patterns: one pass, no parser. Ordered walks are in operators.dom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import MediaProfile, identify_asset

# Attributes that name a file.
FILE_ATTRIBUTES = ("src", "srcset", "href", "poster", "data-src", "data-srcset", "data-lazy-src", "data-lazy-srcset")
# How a quote is spelled around a reference in a style.
QUOTES = ('"', "'", "&quot;", "&apos;", "&#34;", "&#39;", "&#034;", "&#039;")
# Tags whose reference names a file.
ASSET_TAGS = ("img", "script", "source", "video", "audio", "track", "embed", "object", "iframe", "link")


def all_of(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), group)


def head_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<head\b[^>]*>(.*?)</head>", 1)


def title_of(html: Column) -> Column:
    """The title, or null."""
    return F.when(html.rlike(r"(?is)<title\b[^>]*>.*?</title>"), F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))


def html_lang(html: Column) -> Column:
    v = F.trim(F.regexp_extract(F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1), r"""(?i)\blang\s*=\s*["']?([^"'\s>]*)""", 1))
    return F.when(v != "", v)


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, attributes in either order; the last wins; null without one."""
    tags = F.filter(all_of(head_of(html), r"(?is)(<meta\b[^>]*>)"), lambda t: t.rlike(rf"""(?i)\b(name|property)\s*=\s*["']{name}["']"""))
    last = F.element_at(F.when(F.size(tags) > 0, tags), -1)
    return F.regexp_extract(last, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)


def canonicals(html: Column) -> Column:
    tags = F.filter(all_of(html, r"(?is)(<link\b[^>]*>)"), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical"""))
    return F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]*)""", 1))


def json_ld(html: Column) -> Column:
    return all_of(html, r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")


def heading_levels(html: Column) -> Column:
    return F.transform(all_of(html, r"(?i)<h([1-6])\b"), lambda x: x.cast("int"))


def landmarks(html: Column) -> Column:
    return F.transform(all_of(html, r"(?i)<(header|nav|main|footer)\b"), lambda x: F.lower(x))


def let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def after_each(s: Column, mark: str, of) -> Column:
    """of(what stands before a mark since the last one, what follows it up to the next) for every place of a literal mark."""
    return F.when(s.contains(mark), let(F.split(s, f"\\Q{mark}\\E", -1), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: of(p[i - 1], p[i])))).otherwise(F.array())


def quoted_values(html: Column) -> Column:
    """array of struct(name, value): attributes with a quoted value that holds no quote. The text is cut at every equals sign before a quote:
    the name ends the piece before it, the value begins the piece after it."""

    def of(before: Column, after: Column) -> Column:
        quote = F.substring(after, 1, 1)
        rest = F.substring(after, 2, 1 << 30)
        value = F.when(quote == '"', F.substring_index(rest, '"', 1)).otherwise(F.substring_index(rest, "'", 1))
        closed = (F.length(value) + 2 <= F.length(after)) & ~value.contains('"') & ~value.contains("'")
        return F.struct(F.lower(F.regexp_extract(F.right(before, F.lit(40)), "([A-Za-z0-9_-]+)$", 1)).alias("name"), F.when(closed, value).alias("value"))

    pieces = F.split(html, "=(?=[\"'])", -1)
    every = let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: of(p[i - 1], p[i]))).otherwise(F.array()))
    return F.filter(every, lambda a: a["value"].isNotNull())


def file_attribute(name: Column) -> Column:
    """The attribute of the table that a name is or ends with, behind a hyphen; the longest; null for none."""
    out = F.lit(None).cast("string")
    for a in sorted(FILE_ATTRIBUTES, key=len):
        out = F.when((name == a) | name.endswith(f"-{a}"), a).otherwise(out)
    return out


def _unquoted(s: Column) -> Column:
    """Without one quote at each end, in any spelling."""
    s = F.trim(s)
    head = F.coalesce(*[F.when(s.startswith(q), F.substring(s, len(q) + 1, 1 << 30)) for q in QUOTES], s)
    return let(head, lambda h: F.coalesce(*[F.when(h.endswith(q), F.left(h, F.length(h) - len(q))) for q in QUOTES], h))


def style_references(html: Column) -> Column:
    """What url() names, without quotes."""
    named = F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?i)url[(]([^)]*)[)]"), 1), _unquoted), lambda u: (u != "") & ~u.contains('"') & ~u.contains("'"))
    return F.when(F.lower(html).contains("url("), named).otherwise(F.array())


def markdown_references(text: Column) -> Column:
    """Destinations of inline links and images: an open bracket before, a destination without blanks, perhaps a title in quotes, and the end."""

    def of(before: Column, after: Column) -> Column:
        opened = F.substring_index(before, "]", -1).contains("[")
        to = F.regexp_extract(after, "^[^ \\t\\r\\n\\f)]+", 0)
        rest = F.substring(after, F.length(to) + 1, F.lit(1 << 30))
        ends = rest.startswith(")") | (rest.rlike("^\\s") & F.ltrim(F.regexp_replace(rest, "^\\s+", "")).rlike('^"[^"]*"[)]'))
        return F.when(opened & ends & (to != ""), to)

    return F.array_compact(after_each(text, "](", of))


def references(html: Column) -> Column:
    """array of struct(url, kind): attributes, then CSS url(), then Markdown links; srcset split to its URLs; empty values are skipped."""

    def of(x: Column) -> Column:
        sets = x["name"].endswith("srcset")
        many = F.transform(F.filter(F.split(x["value"], ",", -1), lambda c: F.trim(c) != ""), lambda c: F.split(F.trim(c), "\\s+", -1)[0])
        urls = F.when(x["value"] == "", F.array().cast("array<string>")).when(sets, many).otherwise(F.array(x["value"]))
        kind = F.when(sets, "srcset").when(x["name"].startswith("data-"), "lazy").otherwise(x["name"])
        return F.transform(urls, lambda u: F.struct(u.alias("url"), kind.alias("kind")))

    known = F.transform(quoted_values(html), lambda a: F.struct(file_attribute(a["name"]).alias("name"), a["value"].alias("value")))
    named = lambda urls, kind: F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))
    return F.concat(F.flatten(F.transform(F.filter(known, lambda a: a["name"].isNotNull()), of)), named(style_references(html), "css"), named(markdown_references(html), "markdown"))


def asset_references(html: Column, profile: MediaProfile) -> Column:
    """array of struct(url, kind, asset): references with what they name; a link counts only where it names a file of the site's own."""
    known = F.transform(references(html), lambda r: F.struct(r["url"].alias("url"), r["kind"].alias("kind"), identify_asset(r["url"], profile).alias("asset")))
    return F.filter(known, lambda r: (r["kind"] != "href") | r["asset"]["classification"].isin("SUPPORTED", "CONFIGURED"))


def link_references(html: Column) -> Column:
    """array of struct(tag, attribute, raw) of href and src, quoted or bare; empty values are skipped."""
    tag = r"(?is)<([a-z][a-z0-9-]*)\b([^>]*)>"
    tags = F.arrays_zip(all_of(html, tag, 1).alias("t"), all_of(html, tag, 2).alias("b"))
    tags = F.filter(tags, lambda x: x["b"].rlike(r"(?i)\b(href|src)\s*="))

    def of(x: Column) -> Column:
        attr = r"""(?i)\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>=`]+))"""
        zipped = F.arrays_zip(all_of(x["b"], attr, 1).alias("a"), all_of(x["b"], attr, 2).alias("p"), all_of(x["b"], attr, 3).alias("q"), all_of(x["b"], attr, 4).alias("r"))
        return F.transform(zipped, lambda z: F.struct(F.lower(x["t"]).alias("tag"), F.lower(z["a"]).alias("attribute"), F.concat(z["p"], z["q"], z["r"]).alias("raw")))

    return F.filter(F.flatten(F.transform(tags, of)), lambda r: r["raw"] != "")


def declares_base(html: Column) -> Column:
    return html.rlike(r"(?i)<base\b")


def inline_handlers(html: Column) -> Column:
    return F.size(all_of(html, r"(?i)<[a-z][^>]*\s(on[a-z]+)\s*=")).cast("long")
