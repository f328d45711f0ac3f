"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from . import bridge as B
from ..operators.discovery import folded
from .registry import query

o = B.oracle

_FAMILY = "CASE WHEN q <> '' AND regexp_matches(q, '(^|&)s(=|&|$)') THEN 'search' WHEN q <> '' THEN 'query-variant' WHEN seg IN ('de', 'fr') THEN 'translated' WHEN regexp_matches(p, '\\.[A-Za-z0-9]{1,5}$') THEN 'media' ELSE 'page' END"


@query("entry_url_families", o(f", x AS (SELECT regexp_extract(key, '^([^?#]*)', 1) AS p, regexp_extract(key, '\\?(.*)$', 1) AS q FROM k_), y AS (SELECT *, string_split(p, '/')[2] AS seg FROM x) SELECT {_FAMILY} AS family, count(*)::BIGINT AS n FROM y GROUP BY 1"))
def entry_url_families(spark, d):
    return B.pages(spark, d).select(U.classify_family(U.comparison_key(F.col("url")), B.LINKS).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("f01_expand_pattern", o("SELECT doc_id, '/' || strftime(published, '%Y/%m') || '/' || slug || '/' AS path FROM posts"))
def f01(spark, d):
    p = B.posts(spark, d)
    return p.select("doc_id", U.expand("/%year%/%monthnum%/%postname%/", year=F.date_format("published", "yyyy"), monthnum=F.date_format("published", "MM"), postname=F.col("slug")).alias("path"))


@query("f02_post_path", o("SELECT doc_id, '/' || categories[1] || '/' || author || '/' || slug || '/' AS path FROM posts"))
def f02(spark, d):
    p = B.posts(spark, d)
    return p.select("doc_id", U.expand("/%category%/%author%/%postname%/", category=F.col("categories")[0], author=F.col("author"), postname=F.col("slug")).alias("path"))


@query("f03_author_path", o("SELECT DISTINCT '/author/' || author || '/' AS path FROM posts"))
def f03(spark, d):
    return B.posts(spark, d).select(U.expand(B.LINKS.author, nicename=F.col("author")).alias("path")).distinct()


@query("f06_paginated_path", o("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '/blog/' ELSE '/blog/page/' || doc_id % 5 || '/' END AS path FROM documents"))
def f06(spark, d):
    return B.table(spark, d, "documents").select("doc_id", U.paginated(F.lit("/blog/"), F.col("doc_id") % 5).alias("path"))


@query("f08_permalink_match", o(r"SELECT page_id, regexp_matches(path, '^/[^/]+/?$') AS post, regexp_matches(path, '^/[^?#]+/?$') AS page, regexp_matches(path, '^/en/\d{2}/?$') AS dated FROM live"))
def f08(spark, d):
    p = U.path_part(F.col("key"))
    return B.live(spark, d).select("page_id", p.rlike(U.pattern_regex("/%postname%/")).alias("post"), p.rlike(U.pattern_regex("/%pagename%/")).alias("page"), p.rlike(U.pattern_regex("/en/%day%/")).alias("dated"))


@query("f09_classify_family", o("SELECT page_id, key, family FROM live"))
def f09(spark, d):
    return B.live(spark, d).select("page_id", "key", "family")


@query("f10_site_path", o(r"""SELECT doc_id, '/x/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.xml' ELSE '/' END || CASE WHEN doc_id % 2 = 0 THEN '?a=1' ELSE '' END AS path FROM documents"""))
def f10(spark, d):
    raw = F.concat(F.lit("x//"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".xml").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "?a=1").otherwise(""))
    return B.table(spark, d, "documents").select("doc_id", U.site_path(raw).alias("path"))


@query("f11_trimmed_path", o("SELECT page_id, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path FROM live"))
def f11(spark, d):
    return B.live(spark, d).select("page_id", U.trim_slashes(U.path_part(F.col("key"))).alias("path"))


@query("f12_comparable_path", o("SELECT doc_id, '/a b' || doc_id || '/c%2Fd/' || CASE WHEN doc_id % 2 = 0 THEN '%zz' ELSE 'é' END AS path FROM documents"))
def f12(spark, d):
    raw = F.concat(F.lit("/a%20b"), F.col("doc_id"), F.lit("/c%2Fd/"), F.when(F.col("doc_id") % 2 == 0, "%zz").otherwise("%C3%A9"))
    return B.table(spark, d, "documents").select("doc_id", U.decoded_path(raw).alias("path"))


@query("f13_comparison_key", o("SELECT page_id, CASE WHEN url LIKE 'https://%' AND regexp_extract(url, '^https://([^/?#]*)', 1) = 'blog.theren.example.net' THEN key END AS own, key FROM k_"))
def f13(spark, d):
    return B.pages(spark, d).select("page_id", U.comparison_key(F.col("url"), F.lit("https://blog.theren.example.net")).alias("own"), U.comparison_key(F.col("url")).alias("key"))


@query("f14_strip_language", o("SELECT page_id, CASE WHEN string_split(path, '/')[2] IN ('de', 'fr') THEN coalesce(nullif(regexp_replace(path, '^/[^/]+', ''), ''), '/') ELSE path END AS path FROM live"))
def f14(spark, d):
    return B.live(spark, d).select("page_id", U.strip_language(U.path_part(F.col("key")), B.LINKS.languages).alias("path"))


@query("f15_absolute_url", o("SELECT page_id, 'https://new.example' || path AS url, CASE WHEN page_id % 2 = 0 THEN 'en_US' ELSE 'fr' END AS locale FROM live"))
def f15(spark, d):
    t = B.live(spark, d)
    return t.select("page_id", U.absolute_url(U.path_part(F.col("key")), "https://new.example/").alias("url"), U.og_locale(F.when(F.col("page_id") % 2 == 0, "en-us").otherwise("fr")).alias("locale"))


@query("f16_page_file", o("SELECT page_id, CASE WHEN trim(path, '/') = '' THEN 'index.html' ELSE trim(path, '/') || '/index.html' END AS file FROM live"))
def f16(spark, d):
    return B.live(spark, d).select("page_id", U.page_file(U.path_part(F.col("key"))).alias("file"))


@query("f17_reference_scope", o("SELECT doc_id, CASE WHEN raw LIKE '#%' THEN 'fragment' WHEN raw LIKE '//%' OR regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' WHEN raw LIKE '/%' THEN 'internal' ELSE 'relative' END AS scope FROM assets"))
def f17(spark, d):
    return B.assets(spark, d).select("doc_id", U.scope_of(F.col("raw")).alias("scope"))


@query("f18_split_reference", o(r"SELECT doc_id, regexp_extract(raw, '^([^?#]*)', 1) AS path, regexp_extract(raw, '^[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(raw, '(#.*)$', 1) AS fragment FROM assets"))
def f18(spark, d):
    r = F.col("raw")
    return B.assets(spark, d).select("doc_id", U.path_part(r).alias("path"), U.query_part(r).alias("query"), U.fragment_part(r).alias("fragment"))


_ASSET = """, a1 AS (SELECT doc_id, regexp_extract(raw, '^([^?#]*)', 1) AS p, raw FROM assets),
a2 AS (SELECT *, regexp_replace(lower(regexp_extract(regexp_replace(p, '^//', 'https://'), '^https?://([^/]*)', 1)), '^www\\.', '') AS host, regexp_replace(p, '^(https?:)?//[^/]*', '') AS inner_ FROM a1),
asset_ids AS (SELECT doc_id, raw, host, inner_, CASE
  WHEN raw LIKE '#%' OR raw LIKE 'data:%' THEN 'UNSUPPORTED'
  WHEN host <> '' AND host <> 'site.example' THEN 'EXTERNAL'
  WHEN inner_ LIKE '/wp-content/uploads/%' THEN CASE WHEN inner_ LIKE '%/' OR inner_ LIKE '%/../%' THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END
  WHEN inner_ LIKE '/files/%' THEN 'CONFIGURED' WHEN inner_ LIKE '/media/%' THEN 'SUPPORTED'
  WHEN host <> '' THEN 'EXTERNAL' ELSE 'UNSUPPORTED' END AS classification FROM a2),
asset_keys AS (SELECT *, CASE WHEN classification IN ('SUPPORTED', 'CONFIGURED') THEN 'uploads:' || regexp_replace(inner_, '^/(wp-content/uploads|files|media)/', '') END AS key FROM asset_ids)"""


@query("f19_identify_asset", o(_ASSET + " SELECT doc_id, classification, key, '/media/' || substr(key, 9) AS local FROM asset_keys"))
def f19(spark, d):
    t = B.assets(spark, d).withColumn("a", U.identify_asset(F.col("raw"), B.MEDIA))
    return t.select("doc_id", "a.classification", "a.key", "a.local")


@query("f20_slug", o(r"SELECT doc_id, s AS slug, regexp_matches(s, '^[a-z0-9_]+(-[a-z0-9_]+)*$') AS good FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 'Doc-' || doc_id WHEN 2 THEN 'doc--' || doc_id ELSE '-doc' END AS s FROM documents)"))
def f20(spark, d):
    i = F.col("doc_id").cast("string")
    s = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("doc-"), i)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Doc-"), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("doc--"), i)).otherwise("-doc")
    return B.table(spark, d, "documents").select("doc_id", s.alias("slug"), U.is_slug(s).alias("good"))


@query("f21_identities", o("SELECT doc_id, 'posts/' || slug || '@' || locale AS id, 'posts' AS kind, locale, 'wp:post/post#' || doc_id || '@' || locale AS source_key FROM posts"))
def f21(spark, d):
    p = B.posts(spark, d).withColumn("id", U.entry_id(F.lit("posts"), F.col("slug"), F.col("locale")))
    return p.select("doc_id", "id", U.kind_of(F.col("id")).alias("kind"), U.locale_of(F.col("id")).alias("locale"), U.source_key(F.lit("post"), F.lit("post"), F.col("doc_id"), F.col("locale")).alias("source_key"))


@query("f23_claim", o("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'redirect' WHEN doc_id % 3 = 0 THEN 'content' WHEN doc_id % 2 = 0 THEN 'module' ELSE 'none' END AS claim FROM documents"))
def f23(spark, d):
    t = B.table(spark, d, "documents")
    flag = lambda n: F.when(F.col("doc_id") % n == 0, F.lit(True))
    return t.select("doc_id", F.coalesce(*[F.when(flag(n), F.lit(v)) for n, v in ((5, "redirect"), (3, "content"), (2, "module"))], F.lit("none")).alias("claim"))


@query("f24_dates", o("SELECT doc_id, try_cast(s[1:10] AS DATE) IS NOT NULL AS real, s[1:10] AS day FROM (SELECT doc_id, '2024-02-' || lpad((doc_id % 40)::VARCHAR, 2, '0') || 'T01:00:00' AS s FROM documents)"))
def f24(spark, d):
    s = F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("T01:00:00"))
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    return B.table(spark, d, "documents").select("doc_id", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull().alias("real"), day.alias("day"))


@query("f26_same_language", o("SELECT p.page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CASE WHEN p.page_id % 4 = 0 THEN NULL ELSE regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) = 'en' END AS same FROM pages p"))
def f26(spark, d):
    lang = H.html_lang(F.col("html"))
    return B.pages(spark, d).select("page_id", lang.alias("lang"), T.same_language(lang, F.when(F.col("page_id") % 4 != 0, "EN-us")).alias("same"))


_REF = "'&(#?[A-Za-z0-9]+);'"
_NAMED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ENTITIES.items()) + "}"
_CODE = "(CASE WHEN regexp_matches({n}, '^#[0-9]{{1,8}}$') THEN try_cast({n}[2:] AS INT) WHEN regexp_matches({n}, '^#[xX][0-9A-Fa-f]{{1,7}}$') THEN try_cast('0x' || {n}[3:] AS INT) END)"
_ONE = "coalesce({m}[{n}], {m}[lower({n})], CASE WHEN " + _CODE + " BETWEEN 1 AND 55295 OR " + _CODE + " BETWEEN 57344 AND 1114111 THEN chr(" + _CODE + ") END, '&' || {n} || ';')"


def _ent(x: str) -> str:
    """Named and numbered references decoded: what stands between them and what they mean, in turns."""
    gaps, names = f"regexp_split_to_array({x}, {_REF})", f"regexp_extract_all({x}, {_REF}, 1)"
    return f"(SELECT list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(n) THEN {_ONE.format(n='n[i]', m=_NAMED)} ELSE '' END), 'string_agg', '') FROM (SELECT {gaps} AS g, {names} AS n))"


_SQUASH = "trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query("f30_decode_entities", o("SELECT page_id, " + _ent("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " AS title FROM pages"))
def f30(spark, d):
    return B.pages(spark, d).select("page_id", T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("f31_bare_text", o("SELECT page_id, md5(" + _SQUASH.format(x=_ent("regexp_replace(html, '<[^>]+>', '', 'g')")) + ") AS digest FROM pages"))
def f31(spark, d):
    return B.pages(spark, d).select("page_id", F.md5(T.bare_text(F.col("html"))).alias("digest"))


_MARKS = (("&amp;", "&", 1), ("&lt;", "<", 2), ("&gt;", ">", 3), ("&quot;", '"', 4), ("&#39;", "''", 5))
_VIS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)</?(?:" + T.BLOCKS + ")\\b[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g')"
for _e, _c, _n in _MARKS:
    _VIS = f"replace({_VIS}, '{_e}', chr({_n}))"
for _e, _c in (("&#8217;", "’"), ("&#8216;", "‘"), ("&#8220;", "“"), ("&#8221;", "”")):
    _VIS = f"replace({_VIS}, '{_e}', '{_c}')"
_VIS = f"regexp_replace({_VIS}, '(?i)&[a-z#0-9]+;', ' ', 'g')"
for _e, _c, _n in _MARKS:
    _VIS = f"replace({_VIS}, chr({_n}), '{_c}')"
_VIS = _SQUASH.format(x=_VIS)


@query("f32_visible_text", o(f"SELECT page_id, md5({_VIS}) AS digest FROM pages"))
def f32(spark, d):
    return B.pages(spark, d).select("page_id", F.md5(T.visible_text(F.col("html"))).alias("digest"))


@query("f33_comparison_text", o("SELECT page_id, lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'), '\\s*/\\s*', '/', 'g'))) AS key FROM pages"))
def f33(spark, d):
    return B.pages(spark, d).select("page_id", T.comparison_text(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)).alias("key"))


@query("f35_search_terms", o(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(strip_accents(title)), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') AS terms FROM posts"))
def f35(spark, d):
    return B.posts(spark, d).select("doc_id", folded(F.col("title")).alias("t")).select("doc_id", F.array_join(F.array_sort(T.search_terms(F.col("t"))), " ").alias("terms"))


@query("f36_reading_time", o(f", w AS (SELECT page_id, len(list_filter(string_split({_VIS}, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))::BIGINT AS words FROM pages) SELECT page_id, words, CASE WHEN words = 0 THEN 0 ELSE greatest(1, floor(words / 200 + 0.5)) END::BIGINT AS minutes FROM w"))
def f36(spark, d):
    t = B.pages(spark, d).select("page_id", T.word_count(F.col("html")).alias("words"))
    return t.withColumn("minutes", T.reading_minutes(F.col("words")))


_CUT = "CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(CASE WHEN substr({x}, 1, {n}) LIKE '% %' THEN regexp_replace(substr({x}, 1, {n}), '(?s) [^ ]*$', '') ELSE substr({x}, 1, {n}) END, '[.,;:]$', '') || '…' END"


@query("f40_truncate_at_word", o("SELECT doc_id, " + _CUT.format(x="title", n=60) + " AS short FROM posts"))
def f40(spark, d):
    return B.posts(spark, d).select("doc_id", T.truncate_at_word(F.col("title"), 60).alias("short"))


_TAGS = ", ".join(f"'{t}'" for t in sorted(T.STRUCTURAL))
_H, _W = r"regexp_replace(x, '^\s+', '')", r"regexp_extract(x, '^\s*(\S+)', 1)"
_IS_PROSE = rf"""({_H} <> '' AND NOT ({_H} <> {_W} AND (regexp_matches({_W}, '^#{{1,6}}$') OR {_W} IN ('-', '*', '+') OR regexp_matches({_W}, '^[0-9]+[.)]$')))
  AND NOT (left({_W}, 1) IN ('>', '|') OR starts_with({_W}, ':::') OR regexp_replace({_H}, '\s+$', '') = '---') AND lower(regexp_extract({_H}, '^<([A-Za-z0-9]+)', 1)) NOT IN ({_TAGS}))"""
_LINE = f"coalesce(list_filter(regexp_split_to_array(body, '\\r?\\n'), lambda x: {_IS_PROSE})[1], '')"
_PROSE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _LINE + ", '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`]+', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"


@query("f41_first_prose", o(f"SELECT doc_id, {_PROSE} AS prose FROM posts"))
def f41(spark, d):
    return B.posts(spark, d).select("doc_id", T.first_prose(F.col("body")).alias("prose"))


@query("f42_summary", o(f", s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Excerpt ' || doc_id ELSE {_PROSE} END AS x FROM posts) SELECT doc_id, " + _CUT.format(x="x", n=180) + " AS summary FROM s"))
def f42(spark, d):
    p = B.posts(spark, d)
    return p.select("doc_id", T.summary(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<p>Excerpt "), F.col("doc_id"), F.lit("</p>"))), F.col("body")).alias("summary"))


_MARKED = "(SELECT doc_id, coalesce(text, '') || ' ' || ['<i class=\"elementor-section x\">', '<i class=\"et_pb_row\">', 'vc_row', '<b class=\"fl-module\">', '<!-- wp:block {', 'vc_row elementor-widget', 'fl-modules et_pb_rows'][length(coalesce(text, '')) % 7 + 1] AS m FROM documents)"
_BUILDER = """CASE WHEN regexp_matches(m, 'elementor-(section|widget|element|container)\\b') THEN 'elementor' WHEN regexp_matches(m, '\\bet_pb_(section|row|module)\\b') THEN 'divi' WHEN regexp_matches(m, '\\b(vc_row|wpb_wrapper|vc_column)\\b') THEN 'wpbakery'
  WHEN regexp_matches(m, '\\bfl-(builder-content|row|module)\\b') THEN 'beaver-builder' WHEN regexp_matches(m, '<!--\\s*wp:block\\s') THEN 'gutenberg-reusable' END"""


def marked(spark, d):
    marks = ['<i class="elementor-section x">', '<i class="et_pb_row">', "vc_row", '<b class="fl-module">', "<!-- wp:block {", "vc_row elementor-widget", "fl-modules et_pb_rows"]
    text = F.coalesce("text", F.lit(""))
    return B.table(spark, d, "documents").select("doc_id", F.concat(text, F.lit(" "), F.array(*[F.lit(x) for x in marks])[F.length(text) % 7]).alias("m"))


@query("f43_builder", o(f"SELECT doc_id, {_BUILDER} AS builder FROM {_MARKED}"))
def f43(spark, d):
    return marked(spark, d).select("doc_id", T.builder_of(F.col("m")).alias("builder"))


_TAIL = ", newest first — the full archive."


@query("f44_archive_description", o(f"""SELECT slug, kind, CASE WHEN kind = 'term' AND length(own) >= 50 THEN own WHEN kind = 'term' THEN 'Everything filed under the region ' || name || ' on Site{_TAIL}' WHEN kind = 'posts' THEN 'Every post published on Site{_TAIL}'
  WHEN kind = 'author' THEN 'Every post written by ' || name || ' on Site{_TAIL}' WHEN kind = 'tag' THEN 'Every post tagged ' || name || ' on Site{_TAIL}' ELSE 'Every post filed under ' || name || ' on Site{_TAIL}' END AS description
  FROM (SELECT terms.slug, name, regexp_replace(coalesce(title, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS own, unnest(['posts', 'author', 'tag', 'term', 'category']) AS kind FROM terms LEFT JOIN posts ON 'n' || doc_id = terms.slug)"""))
def f44(spark, d):
    own = B.posts(spark, d).select(F.concat(F.lit("n"), F.col("doc_id")).alias("slug"), F.col("title").alias("own"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("posts", "author", "tag", "term", "category")]))
    t = B.terms(spark, d).join(own, "slug", "left").withColumn("kind", kinds)
    site, label = F.lit("Site"), F.lit("region")
    said = F.when(F.col("kind") == "term", T.term_description(F.col("own"), F.col("name"), site, label)).otherwise(T.archive_description(F.col("kind"), F.col("name"), site, label))
    return t.select("slug", "kind", said.alias("description"))


@query("f45_anchor", o(r"SELECT doc_id, replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}\p{M}_ -]', '', 'g'), ' ', '-') AS anchor FROM posts"))
def f45(spark, d):
    return B.posts(spark, d).select("doc_id", T.anchor_of(F.col("title")).alias("anchor"))


@query("f46_template_family", o(r"""SELECT page_id, CASE WHEN len(p) < 3 THEN 'top-level' WHEN list_contains(p, 'page') THEN p[1] || '-pagination' ELSE p[1] END AS template
  FROM (SELECT page_id, string_split(CASE WHEN t = '' THEN 'index.html' WHEN t = '404' THEN '404.html' ELSE t || '/index.html' END, '/') AS p FROM (SELECT page_id, trim(path, '/') AS t FROM live))"""))
def f46(spark, d):
    return B.live(spark, d).select("page_id", U.template_family(U.page_file(U.path_part(F.col("key")))).alias("template"))


@query("f50_script_minimum", o(r"SELECT doc_id, CASE WHEN regexp_matches(title, '^[\p{Latin}\p{Cyrillic}\p{Greek}\p{N}\p{P}\p{S}\p{Z}]*$') THEN 3 ELSE 2 END AS least FROM posts"))
def f50(spark, d):
    return B.posts(spark, d).select("doc_id", F.when(F.col("title").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{N}\p{P}\p{S}\p{Z}]*$"), 3).otherwise(2).alias("least"))


@query("f52_says", o(r"SELECT doc_id, regexp_matches(lower(body), '(^|[^\p{L}\p{N}\p{M}])the with($|[^\p{L}\p{N}\p{M}])') AS says FROM posts"))
def f52(spark, d):
    return B.posts(spark, d).select("doc_id", T.says(F.lower("body"), F.lit("the with")).alias("says"))


@query("f53_escape_xml", o("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS url FROM pages"))
def f53(spark, d):
    return B.pages(spark, d).select("page_id", T.escape_xml(F.col("url")).alias("url"))


def _hex(c):
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * c) % 16777216)), 6, "0"))


def _lum(h: str) -> str:
    ch = lambda i: f"(('0x' || substr({h}, {i}, 2))::INT / 255.0::DOUBLE)"
    lin = lambda x: f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
    return f"(0.2126 * ({lin(ch(2))}) + 0.7152 * ({lin(ch(4))}) + 0.0722 * ({lin(ch(6))}))"


_PAL = "pal AS (SELECT p_partkey, '#' || lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0') AS a, '#' || lpad(lower(to_hex((p_partkey * 104729) % 16777216)), 6, '0') AS b FROM part)"


@query("f70_hex_channels", o(f", {_PAL} SELECT p_partkey, ('0x' || substr(a, 2, 2))::INT AS r, ('0x' || substr(a, 4, 2))::INT AS g, ('0x' || substr(a, 6, 2))::INT AS b FROM pal"))
def f70(spark, d):
    h = _hex(7919)
    return B.table(spark, d, "part").select("p_partkey", C.channel(h, 0).alias("r"), C.channel(h, 1).alias("g"), C.channel(h, 2).alias("b"))


@query("f71_luminance", o(f", {_PAL} SELECT p_partkey, round({_lum('a')}, 6) AS luminance FROM pal"))
def f71(spark, d):
    return B.table(spark, d, "part").select("p_partkey", F.round(C.luminance(_hex(7919)), 6).alias("luminance"))


@query("f72_contrast", o(f", {_PAL}, c AS (SELECT p_partkey, floor((greatest({_lum('a')}, {_lum('b')}) + 0.05) / (least({_lum('a')}, {_lum('b')}) + 0.05) * 100 + 0.5) / 100 AS ratio FROM pal) SELECT p_partkey, ratio, ratio >= 4.5 AS enough FROM c"))
def f72(spark, d):
    t = B.table(spark, d, "part").select("p_partkey", C.contrast(_hex(7919), _hex(104729)).alias("ratio"))
    return t.withColumn("enough", F.col("ratio") >= 4.5)


@query("f74_round_half_up", o("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 100 - 500 + 0.5)::BIGINT AS r FROM lineitem"))
def f74(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.round_half_up(F.col("l_extendedprice") / 100 - 500).cast("long").alias("r"))


@query("x01_find_references", o(r"""SELECT page_id, unnest(CASE WHEN kind = 'srcset' THEN list_transform(list_filter(string_split(v, ','), lambda c: trim(c) <> ''), lambda c: regexp_extract(trim(c), '^(\S*)', 1)) ELSE [v] END) AS url, kind FROM
  (SELECT page_id, regexp_extract(a, '(?i)=["''](.*)["'']$', 1) AS v, CASE WHEN lower(a) SIMILAR TO '[a-z-]*srcset=.*' THEN 'srcset' WHEN starts_with(lower(a), 'data-') THEN 'lazy' ELSE lower(regexp_extract(a, '^([A-Za-z-]+)', 1)) END AS kind
   FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\b(?:src|srcset|href|poster|data-src|data-srcset|data-lazy-src|data-lazy-srcset)=(?:"[^"'']*"|''[^"'']*'')')) AS a FROM pages)) WHERE v <> ''"""))
def x01(spark, d):
    return B.pages(spark, d).select("page_id", F.explode(H.references(F.col("html"))).alias("r")).select("page_id", "r.url", "r.kind")


@query("x03_collect_references", o("SELECT page_id, tag, attribute, raw FROM refs"))
def x03(spark, d):
    return B.refs(spark, d).select("page_id", "tag", "attribute", "raw")


@query("x05_head", o(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?is)<link\b[^>]*>'))::BIGINT AS links, len(regexp_extract_all(html, '(?is)<meta\b[^>]*>'))::BIGINT AS metas FROM pages"""))
def x05(spark, d):
    h = F.col("html")
    return B.pages(spark, d).select("page_id", H.title_of(h).alias("title"), H.html_lang(h).alias("lang"), F.size(H.all_of(h, r"(?is)(<link\b[^>]*>)")).cast("long").alias("links"), F.size(H.all_of(h, r"(?is)(<meta\b[^>]*>)")).cast("long").alias("metas"))


@query("x06_source_head", o("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T' || page_id END AS title, CASE page_id % 3 WHEN 0 THEN 'D' || page_id WHEN 1 THEN 'O' || page_id END AS description FROM pages"))
def x06(spark, d):
    i = F.col("page_id").cast("string")
    h = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<head><title>T"), i, F.lit('</title><meta content="D'), i, F.lit('" name="description"></head>'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<head><meta property="og:description" content="O'), i, F.lit('"></head>'))).otherwise("<head></head>")
    t = B.pages(spark, d).select("page_id", h.alias("h"))
    return t.select("page_id", H.title_of(F.col("h")).alias("title"), F.coalesce(H.meta(F.col("h"), "description"), H.meta(F.col("h"), "og:description")).alias("description"))


@query("x07_headings_landmarks", o("SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<h([1-6])\\b', 1), ',') AS levels, array_to_string(list_transform(regexp_extract_all(html, '(?i)<(header|nav|main|footer)\\b', 1), lambda x: lower(x)), ',') AS landmarks FROM pages"))
def x07(spark, d):
    h = F.col("html")
    return B.pages(spark, d).select("page_id", F.array_join(H.heading_levels(h), ",").alias("levels"), F.array_join(H.landmarks(h), ",").alias("landmarks"))


@query("x08_interactive_elements", o("SELECT page_id, lower(t) AS tag, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(a|button|input|select|textarea|summary|ul|ol)\\b', 1)) AS t FROM pages) GROUP BY ALL"))
def x08(spark, d):
    return B.pages(spark, d).select("page_id", F.explode(H.all_of(F.col("html"), r"(?i)<(a|button|input|select|textarea|summary|ul|ol)\b")).alias("t")).groupBy("page_id", F.lower("t").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("x15_scripts_and_base", o("SELECT page_id, regexp_matches(html, '(?i)<base\\b') AS base, len(regexp_extract_all(html, '(?i)<script\\b'))::BIGINT AS scripts FROM pages"))
def x15(spark, d):
    h = F.col("html")
    return B.pages(spark, d).select("page_id", H.declares_base(h).alias("base"), F.size(H.all_of(h, r"(?i)(<script\b)")).cast("long").alias("scripts"))


@query("r02_media_origin", o("SELECT page_id, md5(regexp_replace(html, 'href=\"/([^\"]*)\"', 'href=\"https://cdn.example/\\1\"', 'g')) AS digest FROM pages"))
def r02(spark, d):
    return B.pages(spark, d).select("page_id", F.md5(F.regexp_replace("html", r'href="/([^"]*)"', 'href="https://cdn.example/$1"')).alias("digest"))


@query("r04_defer_images", o("SELECT doc_id, '<p><img loading=\"lazy\" decoding=\"async\" src=\"/a' || doc_id || '.png\"><img loading=\"eager\" src=\"/b.png\"></p>' AS html FROM documents"))
def r04(spark, d):
    h = F.concat(F.lit('<p><img src="/a'), F.col("doc_id"), F.lit('.png"><img loading="eager" src="/b.png"></p>'))
    return B.table(spark, d, "documents").select("doc_id", F.regexp_replace(h, r"<img(?![^>]*\bloading=)", '<img loading="lazy" decoding="async"').alias("html"))


@query("r06_srcset", o("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE '/i-' || least(p_size, 60) || '.png ' || least(p_size, 60) || 'w, /i-' || greatest(p_size, 60) || '.png ' || greatest(p_size, 60) || 'w' END AS srcset FROM part"))
def r06(spark, d):
    t = B.table(spark, d, "part")
    v = F.array_sort(F.array_compact(F.array(F.lit(60), F.when(F.col("p_size") % 3 != 0, F.col("p_size")))))
    set_ = F.array_join(F.transform(v, lambda w: F.concat(F.lit("/i-"), w.cast("string"), F.lit(".png "), w.cast("string"), F.lit("w"))), ", ")
    return t.select("p_partkey", F.when(F.size(v) >= 2, set_).alias("srcset"))
