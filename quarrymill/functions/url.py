"""URL, path and identity columns. Everything is a Column built from Spark expressions, so predicates and projections stay in codegen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a permalink token matches.
TOKEN_CLASS = {
    "postname": "[^/]+", "pagename": "[^?#]+", "slug": "[^/]+", "nicename": "[^/]+", "category": "[^/]+", "author": "[^/]+",
    "year": r"\d{4}", "monthnum": r"\d{2}", "day": r"\d{2}",
}

# Families that belong to the source system.
INFRASTRUCTURE = ("wp-internal", "media", "feed", "sitemap", "query-variant", "search")

FILE_LIKE = r"\.[A-Za-z0-9]{1,5}$"


@dataclass(frozen=True)
class Permalinks:
    """The permalink shapes of a site."""

    post: str = "/%postname%/"
    page: str = "/%pagename%/"
    category: str = "/category/%slug%/"
    tag: str = "/tag/%slug%/"
    author: str = "/author/%nicename%/"
    posts_index: str = "/blog/"
    pagination: str = "page"
    per_page: int = 10
    languages: tuple[str, ...] = field(default=())


def _pieces(pattern: str) -> tuple[list[str], list[str]]:
    """(literals, tokens) of a permalink pattern: percent signs stand around each token, so the pieces between them take turns."""
    pieces = pattern.split("%")
    return pieces[::2], pieces[1::2]


def pattern_regex(pattern: str) -> str:
    """A permalink pattern as an anchored Java regex, trailing slash optional."""
    import re

    literals, tokens = _pieces(pattern.removesuffix("/"))
    classes = [TOKEN_CLASS.get(t, "[^/]+") for t in tokens] + [""]
    return "^" + "".join(re.escape(a) + b for a, b in zip(literals, classes, strict=True)) + "/?$"


def specificity(pattern: str) -> int:
    """Literal characters of a pattern."""
    return sum(map(len, _pieces(pattern)[0]))


def template_family(file: Column, pagination: str = "page") -> Column:
    """The template of a built file: its first folder, listings' further pages apart; files less than two folders deep are top-level."""
    parts = F.split(file, "/", -1)
    return F.when(F.size(parts) < 3, "top-level").when(F.array_contains(parts, pagination), F.concat(parts[0], F.lit("-pagination"))).otherwise(parts[0])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def host_key(host: Column) -> Column:
    """www. and case do not tell hosts apart."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def path_part(ref: Column) -> Column:
    """What stands before the query and the fragment."""
    return F.regexp_extract(ref, r"^([^?#]*)", 1)


def query_part(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)", 1)


def fragment_part(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(#.*)$", 1)


def decoded_path(path: Column) -> Column:
    """Percent escapes of each segment decoded, unless malformed or unless they hide a separator; segments without % are left alone."""

    def one(seg: Column) -> Column:
        plain = F.try_url_decode(F.regexp_replace(seg, r"\+", "%2B"))
        return F.when(~seg.contains("%") | plain.isNull() | plain.rlike("[/?#]"), seg).otherwise(plain)

    return F.array_join(F.transform(F.split(path, "/", -1), one), "/")


def comparison_key(url: Column, origin: Column | None = None) -> Column:
    """Path plus query, with a slash after paths that are no files; null for what is not http(s) or lies on another origin."""
    rest = F.regexp_replace(url, r"^https?://[^/?#]*", "")
    path = F.when(path_part(rest) == "", "/").otherwise(decoded_path(path_part(rest)))
    query = F.when(query_part(rest) == "?", "").otherwise(query_part(rest))
    key = F.concat(F.when(path.rlike(FILE_LIKE) | path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))), query)
    good = url.rlike("^https?://")
    if origin is not None:
        root = lambda c: F.lower(F.regexp_extract(c, r"^(https?://[^/?#]+)", 1))
        good &= root(url) == root(origin)
    return F.when(good, key)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def strip_language(path: Column, prefixes: tuple[str, ...]) -> Column:
    """The path without its leading language segment."""
    if not prefixes:
        return path
    first = F.get(segments(path), F.lit(0))
    cut = F.regexp_replace(path, r"^/[^/]+", "")
    return F.when(first.isin(*[p.strip("/") for p in prefixes]), F.when(cut == "", "/").otherwise(cut)).otherwise(path)


def classify_family(key: Column, links: Permalinks = Permalinks()) -> Column:
    """The route family of a comparison key: fixed surfaces first, then the configured shapes, the most literal first."""
    import re

    path, query = path_part(key), F.regexp_extract(key, r"\?([^#]*)", 1)
    seg = segments(path)
    first, last = F.get(seg, F.lit(0)), F.element_at(F.when(F.size(seg) > 0, seg), -1)
    index = links.posts_index
    dated = F.when(path.startswith(index), F.substring(path, F.lit(len(index)), F.length(path))).otherwise(path)
    shapes = [(n, p) for n, p in (("post", links.post), ("page", links.page), ("category", links.category), ("tag", links.tag), ("author", links.author))]
    out = (
        F.when((query != "") & query.rlike(r"(^|&)s(=|&|$)"), "search")
        .when(query != "", "query-variant")
        .when(first.isin(*[p.strip("/") for p in links.languages]) if links.languages else F.lit(False), "translated")
        .when(F.size(seg) == 0, "front-page")
        .when(first.isin("wp-admin", "wp-json", "wp-login.php", "xmlrpc.php"), "wp-internal")
        .when(first.isin("wp-content", "wp-includes"), "media")
        .when(path.endswith(".xml") & path.rlike("(?i)sitemap"), "sitemap")
        .when(last == "feed", "feed")
        .when(path.rlike(FILE_LIKE), "media")
        .when(path.rlike(rf"/{re.escape(links.pagination)}/\d+/?$"), "pagination")
        .when(dated.rlike(r"^/\d{4}(/\d{2}(/\d{2})?)?/?$"), "date-archive")
        .when(path == index, "posts-index")
    )
    for weight in sorted({specificity(p) for _, p in shapes}, reverse=True):
        tied = [(n, path.rlike(pattern_regex(p))) for n, p in shapes if specificity(p) == weight]
        hits = F.array_compact(F.array(*[F.when(c, n) for n, c in tied]))
        out = out.when(F.size(hits) == 1, hits[0]).when((F.size(hits) == 2) & F.array_contains(hits, "post") & F.array_contains(hits, "page"), "entry").when(F.size(hits) > 1, "unknown")
    return out.otherwise("unknown")


# Endings of files that a crawl does not read.
ASSET_EXTENSIONS = frozenset("avif css doc docx gif ico jpeg jpg js mjs mp4 pdf png svg webm webp woff woff2 xls xlsx zip".split())


def skip_reason(key: Column, languages: tuple[str, ...] = ()) -> Column:
    """Why a crawl leaves a key unfetched, or null."""
    path, query = path_part(key), F.regexp_extract(key, r"\?(.*)", 1)
    first = F.get(segments(path), F.lit(0))
    return (
        F.when(query != "", "query-variant")
        .when(path.contains(".") & F.lower(F.substring_index(path, ".", -1)).isin(*sorted(ASSET_EXTENSIONS)), "media-asset")
        .when(path.rlike(r"^/(wp-admin|wp-json|wp-login\.php|xmlrpc\.php)"), "wp-runtime")
        .when(path.rlike(r"^/wp-(content|includes)/"), "wp-asset")
        .when((path != "/feed/") & path.endswith("/feed/"), "per-page-feed")
        .when((first.isin(*languages) if languages else F.lit(False)) & (path != F.concat(F.lit("/"), first, F.lit("/"))), "translated-deep-page")
    )


def trim_slashes(path: Column) -> Column:
    """No trailing slash, but / for the root."""
    t = F.regexp_replace(path, "/+$", "")
    return F.when(t == "", "/").otherwise(t)


def site_path(raw: Column) -> Column:
    """One slash between segments, one after a path that is no file; absolute URLs, queries and fragments stay."""
    body = F.regexp_replace(F.concat(F.lit("/"), path_part(raw)), "/{2,}", "/")
    tail = F.regexp_extract(raw, r"([?#].*)$", 1)
    slashed = F.when(body.rlike(FILE_LIKE) | body.endswith("/"), body).otherwise(F.concat(body, F.lit("/")))
    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), raw).otherwise(F.concat(slashed, tail))


def expand(pattern: str, **tokens: Column) -> Column:
    """A permalink from its pattern; null where a token has no value."""
    import re

    parts, last, need = [], 0, F.lit(True)
    for m in re.finditer("%([a-z_]+)%", pattern):
        v = tokens[m[1]].cast("string")
        parts += [F.lit(pattern[last : m.start()]), v]
        need &= v.isNotNull() & (v != "")
        last = m.end()
    return F.when(need, site_path(F.concat(*parts, F.lit(pattern[last:]))))


def paginated(base: Column, n: Column, word: str = "page") -> Column:
    """Page n of a listing; null below 1."""
    return F.when(n == 1, site_path(base)).when(n > 1, site_path(F.concat_ws("/", base, F.lit(word), n.cast("string"))))


def scope_of(raw: Column) -> Column:
    return F.when(raw.startswith("#"), "fragment").when(raw.startswith("//") | raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external").when(raw.startswith("/"), "internal").otherwise("relative")


def page_file(path: Column) -> Column:
    """The file of a page route."""
    p = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(p == "", "index.html").when(p == "404", "404.html").otherwise(F.concat(p, F.lit("/index.html")))


def entry_id(collection: Column, slug: Column, locale: Column) -> Column:
    return F.concat(collection, F.lit("/"), slug, F.lit("@"), locale)


def source_key(kind: Column, type_: Column, id_: Column, locale: Column) -> Column:
    return F.concat(F.lit("wp:"), kind, F.lit("/"), type_, F.lit("#"), id_.cast("string"), F.when(locale.isNotNull(), F.concat(F.lit("@"), locale)).otherwise(""))


def kind_of(identity: Column) -> Column:
    return F.regexp_extract(identity, r"^([^/]*)", 1)


def locale_of(identity: Column) -> Column:
    """After the last @ behind the last slash."""
    return F.regexp_extract(identity, r"@([^@/]*)$", 1)


def is_slug(s: Column) -> Column:
    """Lower-case letters (of any script), digits, marks and underscores, joined by single hyphens."""
    return s.rlike(r"^[\p{Ll}\p{Lo}\p{Lm}\p{N}\p{M}_]+(-[\p{Ll}\p{Lo}\p{Lm}\p{N}\p{M}_]+)*$")


def absolute_url(path: Column, origin: str | None) -> Column:
    """A path on an origin; URLs with a scheme pass, without an origin null."""
    own = F.lit(None).cast("string") if origin is None else F.concat(F.lit(origin.rstrip("/")), path)
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(own)


def og_locale(locale: Column) -> Column:
    return F.when(locale.contains("-"), F.concat(F.lower(F.substring_index(locale, "-", 1)), F.lit("_"), F.upper(F.substring_index(locale, "-", -1)))).otherwise(locale)


@dataclass(frozen=True)
class MediaProfile:
    uploads: str = "wp-content/uploads"
    extra: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    local_base: str = "media"


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def identify_asset(raw: Column, profile: MediaProfile) -> Column:
    """struct(classification, key, local, namespace, path, host) of a reference; the rules apply in order."""
    hosts = [h.lower().removeprefix("www.") for h in profile.hosts]
    spaces = [(profile.uploads, "SUPPORTED", "uploads"), *[(e, "CONFIGURED", "extra") for e in profile.extra], (profile.local_base, "SUPPORTED", "output")]
    roots = [f"/{base.strip('/')}/" for base, _, _ in spaces]
    none = F.lit(None).cast("string")

    def pick(inner: Column, values: list, otherwise: Column) -> Column:
        out = otherwise
        for root, v in reversed(list(zip(roots, values, strict=True))):
            out = F.when(inner.startswith(root), v).otherwise(out)
        return out

    def parts(s: Column) -> Column:
        path = s["path"]
        full = F.when(path.startswith("//"), F.concat(F.lit("https:"), path)).when(path.rlike("(?i)^https?://"), path)
        refused = (s["ref"] == "") | s["ref"].startswith("#") | s["ref"].rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:")
        host = host_key(F.regexp_extract(full, r"(?i)^https?://([^/]*)", 1))
        return F.struct(refused.alias("refused"), host.alias("host"), F.when(full.isNotNull(), F.regexp_replace(full, r"(?i)^https?://[^/]*", "")).otherwise(path).alias("inner"))

    def placed(s: Column) -> Column:
        inner, named = s["inner"], s["host"].isNotNull()
        mine = ~named | (s["host"].isin(*hosts) if hosts else F.lit(False))
        cls = pick(inner, [F.lit(c) for _, c, _ in spaces], none)
        away = F.when(named, "EXTERNAL").otherwise("UNSUPPORTED")
        rel = F.substring(inner, pick(inner, [F.lit(len(r) + 1) for r in roots], F.lit(1)), F.length(inner))
        return F.struct(
            F.when(s["refused"] | (~named & ~inner.startswith("/")), "UNSUPPORTED").when(~mine | cls.isNull(), away).otherwise(cls).alias("cls"),
            pick(inner, [F.lit(n) for _, _, n in spaces], none).alias("space"), rel.alias("rel"), inner.alias("inner"), F.coalesce(s["host"], F.lit("")).alias("host"),
        )

    def answer(s: Column) -> Column:
        bad = (s["rel"] == "") | s["rel"].endswith("/") | F.array_contains(F.split(s["rel"], "/", -1), "..")
        own = s["cls"].isin("SUPPORTED", "CONFIGURED") & ~bad
        keep = lambda v: F.when(own, v)
        return F.struct(
            F.when(s["cls"].isin("SUPPORTED", "CONFIGURED") & bad, "UNSUPPORTED").otherwise(s["cls"]).alias("classification"), keep(F.concat(F.lit("uploads:"), s["rel"])).alias("key"),
            keep(F.concat(F.lit(f"/{profile.local_base.strip('/')}/"), s["rel"])).alias("local"), keep(s["space"]).alias("namespace"),
            F.when(own | (s["cls"] == "EXTERNAL"), s["inner"]).alias("path"), F.when(own | (s["cls"] == "EXTERNAL"), s["host"]).alias("host"),
        )

    ref = F.trim(raw)
    return _let(_let(_let(F.struct(ref.alias("ref"), path_part(ref).alias("path")), parts), placed), answer)


def _segment(stack: Column, seg: Column) -> Column:
    kept, out = stack["kept"], stack["out"]
    return (
        F.when((seg == "") | (seg == "."), stack).when((seg == "..") & (F.size(kept) == 0), F.struct(kept.alias("kept"), F.lit(True).alias("out")))
        .when(seg == "..", F.struct(F.slice(kept, F.lit(1), F.size(kept) - 1).alias("kept"), out.alias("out"))).otherwise(F.struct(F.concat(kept, F.array(seg)).alias("kept"), out.alias("out")))
    )


def normal_path(path: Column) -> Column:
    """struct(path, out): segments of a relative path with . and .. resolved by a stack, joined by slashes; out: did .. leave the root?"""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))
    return F.aggregate(F.split(path, "/", -1), start, _segment, lambda s: F.struct(F.array_join(s["kept"], "/").alias("path"), s["out"].alias("out")))


def resolve(raw: Column, origin: Column) -> Column:
    """A reference as an absolute URL on an origin's root; dot segments go, and do not leave the root."""
    ref = F.trim(raw)
    scheme = ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    full = F.when(scheme, ref).when(ref.startswith("//"), F.concat(F.regexp_extract(origin, "^[a-z]+:", 0), ref)).when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(origin, F.lit("/"), ref))
    root = F.regexp_extract(full, r"^(?i)https?://[^/?#]*", 0)
    rest = F.substring(full, F.length(root) + 1, F.lit(1 << 30))
    path = path_part(rest)
    folded = F.concat(F.lit("/"), normal_path(path)["path"], F.when(path.rlike(r"(/|/\.|/\.\.)$"), "/").otherwise(""))
    folded = F.regexp_replace(folded, "^//$", "/")
    return F.when((root != "") & (F.concat(path, F.lit("/")).contains("/./") | F.concat(path, F.lit("/")).contains("/../")), F.concat(root, folded, F.substring(rest, F.length(path) + 1, F.lit(1 << 30)))).otherwise(full)
