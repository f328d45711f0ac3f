"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import site as S
from ..functions import text as T
from ..functions import url as U
from ..operators import rules as R
from . import bridge as B
from .q_scalar import _ASSET
from .registry import query

o = B.oracle


@query("p01_in_locale", o("SELECT doc_id, slug FROM posts WHERE locale = 'fr'"))
def p01(spark, d):
    return B.posts(spark, d).filter(F.col("locale") == "fr").select("doc_id", "slug")


@query("p02_of_kind", o("SELECT event_id FROM (SELECT * FROM events) WHERE event_type = 'click'"))
def p02(spark, d):
    return B.table(spark, d, "events").filter(F.col("event_type") == "click").select("event_id")


@query("p03_discoverable", o("SELECT doc_id, published::VARCHAR AS published FROM posts p WHERE locale = 'en' ORDER BY p.published DESC, slug"))
def p03(spark, d):
    return B.posts(spark, d).filter("locale = 'en'").orderBy(F.desc("published"), "slug").select("doc_id", F.col("published").cast("string").alias("published"))


@query("p04_index_posts", o("SELECT p.doc_id, p.title, l.key AS href, p.published::VARCHAR AS date FROM posts p JOIN live l ON l.page_id = p.doc_id"))
def p04(spark, d):
    return B.posts(spark, d).join(B.live(spark, d).select(F.col("page_id").alias("doc_id"), "key"), "doc_id").select("doc_id", "title", F.col("key").alias("href"), F.col("published").cast("string").alias("date"))


@query("p05_index_pages", o("SELECT page_id, key AS href, 'page' AS kind, 0::BIGINT AS n_facets FROM live WHERE family IN ('page', 'entry')"))
def p05(spark, d):
    return B.live(spark, d).filter(F.col("family").isin("page", "entry")).select("page_id", F.col("key").alias("href"), F.lit("page").alias("kind"), F.lit(0).cast("long").alias("n_facets"))


@query("p06_search_documents", o("SELECT 'post/' || locale || '/' || slug AS id, title, array_to_string(categories, ',') AS categories FROM posts"))
def p06(spark, d):
    return B.posts(spark, d).select(F.concat_ws("/", F.lit("post"), "locale", "slug").alias("id"), "title", F.array_join("categories", ",").alias("categories"))


@query("p07_drop_source", o("SELECT doc_id, lang, n_chars FROM documents"))
def p07(spark, d):
    return B.table(spark, d, "documents").drop("source", "text")


@query("p08_by_author_category_tag", o("SELECT doc_id FROM posts WHERE author = 'src3' OR list_contains(categories, 'c2') OR list_contains(tags, 't5')"))
def p08(spark, d):
    return B.posts(spark, d).filter((F.col("author") == "src3") | F.array_contains("categories", "c2") | F.array_contains("tags", "t5")).select("doc_id")


_FIXED = ("/search", "/search/", "/404", "/404/", "/404.html", "/", "/page/2", "/blog/page/x/")
_ROUTE = (
    "routes AS (SELECT path FROM live UNION SELECT rtrim(path, '/') || '/page/' || page_id % 9 || '/' FROM live UNION SELECT unnest([" + ", ".join(f"'{p}'" for p in _FIXED) + "]) AS path), "
    "r1 AS (SELECT path, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS t, CASE WHEN length(path) % 5 = 0 THEN 'preview' ELSE 'production' END AS environment FROM routes), "
    "r2 AS (SELECT *, t NOT IN ('/search', '/404', '/404.html') AS indexable, regexp_matches(t, '/page/[0-9]+$') AS paged FROM r1)"
)


def _routes(spark, d):
    """path, environment: the pages' own paths, a further page of each, and paths that no site indexes."""
    t = B.live(spark, d).select(U.path_part(F.col("key")).alias("path"), "page_id")
    more = t.select(F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/page/"), (F.col("page_id") % 9).cast("string"), F.lit("/")).alias("path"))
    every = t.select("path").unionByName(more).unionByName(spark.createDataFrame([(p,) for p in _FIXED], "path string")).distinct()
    return every.withColumn("environment", F.when(F.length("path") % 5 == 0, "preview").otherwise("production"))


@query("p09_indexable_path", o(f", {_ROUTE} SELECT path, indexable FROM r2"))
def p09(spark, d):
    return _routes(spark, d).select("path", S.is_indexable(F.col("path")).alias("indexable"))


@query("p10_robots_directive", o(f", {_ROUTE} SELECT path, CASE WHEN environment = 'production' AND indexable THEN 'index, follow, max-image-preview:large' ELSE 'noindex' END AS robots FROM r2"))
def p10(spark, d):
    return _routes(spark, d).select("path", S.robots_directive(F.col("path"), F.col("environment")).alias("robots"))


@query("p11_sitemap_disposition", o(f", {_ROUTE} SELECT path, CASE WHEN environment = 'preview' THEN 'preview' WHEN NOT indexable THEN 'never' WHEN paged THEN 'pagination' ELSE 'included' END AS disposition FROM r2"))
def p11(spark, d):
    return _routes(spark, d).select("path", S.sitemap_disposition(F.col("path"), F.col("environment")).alias("disposition"))


@query("p12_is_pagination", o(f", {_ROUTE} SELECT path FROM r2 WHERE paged"))
def p12(spark, d):
    return _routes(spark, d).filter(S.is_pagination(F.col("path"))).select("path")


@query("p13_skip_reason", o(r"SELECT page_id, CASE WHEN key LIKE '%?%' THEN 'query-variant' WHEN regexp_matches(path, '(?i)\.(png|jpe?g|webp|avif|gif|svg|css|js|mjs|woff2?|ico|mp4|webm|pdf|zip|docx?|xlsx?)$') THEN 'media-asset' WHEN string_split(path, '/')[2] IN ('de', 'fr') AND path NOT IN ('/de/', '/fr/') THEN 'translated-deep-page' END AS reason FROM live"))
def p13(spark, d):
    return B.live(spark, d).select("page_id", U.skip_reason(F.col("key"), B.LINKS.languages).alias("reason"))


@query("p14_structural_identity", o("SELECT doc_id, id FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '@posts-index' ELSE 'posts/' || slug END AS id FROM posts) WHERE NOT starts_with(id, '@')"))
def p14(spark, d):
    t = B.posts(spark, d).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "@posts-index").otherwise(F.concat(F.lit("posts/"), F.col("slug"))).alias("id"))
    return t.filter(~F.col("id").startswith("@"))


@query("p15_is_migrated", o(_ASSET + " SELECT doc_id FROM asset_ids WHERE classification IN ('SUPPORTED', 'CONFIGURED')"))
def p15(spark, d):
    return B.assets(spark, d).filter(U.identify_asset(F.col("raw"), B.MEDIA)["classification"].isin("SUPPORTED", "CONFIGURED")).select("doc_id")


@query("p16_by_severity", o("SELECT event_id FROM events WHERE event_type IN ('error') AND value > 5"))
def p16(spark, d):
    return B.table(spark, d, "events").filter((F.col("event_type") == "error") & (F.col("value") > 5)).select("event_id")


@query("p17_comparable_key", o("SELECT doc_id FROM posts WHERE length(title) BETWEEN 3 AND 140"))
def p17(spark, d):
    return B.posts(spark, d).filter(F.regexp_count("title", F.lit(r"\X")).between(3, 140)).select("doc_id")


_SEO = "seo AS (SELECT page_id % 40 AS k, min(page_id) AS ord, 'Own ' || (page_id % 40) AS title, CASE WHEN page_id % 40 % 2 = 0 THEN '/c/' || page_id % 40 END AS canonical FROM live WHERE page_id % 5 = 0 GROUP BY ALL)"


def _seo(spark, d):
    k = F.col("page_id") % 40
    return B.live(spark, d).filter("page_id % 5 = 0").select(k.alias("k")).distinct().select("k", F.concat(F.lit("Own "), F.col("k")).alias("title"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("/c/"), F.col("k"))).alias("canonical"))


@query("p18_metadata_coalesce", o(f", {_SEO} SELECT l.page_id, coalesce(s.title, 'Page ' || l.page_id) AS title, CASE WHEN s.title IS NULL THEN 'route' ELSE 'override' END AS origin FROM live l LEFT JOIN seo s ON s.k = l.page_id"))
def p18(spark, d):
    s = _seo(spark, d).select(F.col("k").alias("page_id"), F.col("title").alias("own"))
    return B.live(spark, d).join(s, "page_id", "left").select("page_id", F.coalesce("own", F.concat(F.lit("Page "), F.col("page_id"))).alias("title"), F.when(F.col("own").isNull(), "route").otherwise("override").alias("origin"))


@query("p19_localized_name", o("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'nom ' || n_nationkey WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'slug-' || n_nationkey END AS name FROM nation"))
def p19(spark, d):
    k = F.col("n_nationkey")
    names = F.map_from_entries(F.array_compact(F.array(F.when(k % 2 == 0, F.struct(F.lit("fr").alias("k"), F.concat(F.lit("nom "), k).alias("v"))), F.when(k % 3 == 0, F.struct(F.lit("en").alias("k"), F.col("n_name").alias("v"))))))
    return B.table(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(names, F.lit("fr")), F.try_element_at(names, F.lit("en")), F.concat(F.lit("slug-"), k)).alias("name"))


@query("p20_canonical", o(f", {_SEO} SELECT l.page_id, 'https://new.example' || coalesce(s.canonical, l.path) AS canonical FROM live l LEFT JOIN seo s ON s.k = l.page_id"))
def p20(spark, d):
    s = _seo(spark, d).select(F.col("k").alias("page_id"), "canonical")
    return B.live(spark, d).join(s, "page_id", "left").select("page_id", U.absolute_url(F.coalesce("canonical", U.path_part(F.col("key"))), "https://new.example").alias("canonical"))


@query("p21_sample_rows", o("SELECT 'posts' AS collection, doc_id::BIGINT AS id FROM posts WHERE author = 'src7' UNION ALL SELECT 'pages', page_id::BIGINT FROM live WHERE page_id % 10 = 0"))
def p21(spark, d):
    a = B.posts(spark, d).filter("author = 'src7'").select(F.lit("posts").alias("collection"), F.col("doc_id").cast("long").alias("id"))
    return a.unionByName(B.live(spark, d).filter("page_id % 10 = 0").select(F.lit("pages").alias("collection"), F.col("page_id").cast("long").alias("id")))


_PROV = "prov AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'authored' WHEN 2 THEN 'derived' WHEN 3 THEN 'sample' ELSE 'other' END AS origin, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50)::VARCHAR END AS source_id, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' END AS captured_at, CASE WHEN doc_id % 7 < 3 THEN 'x' END AS derived_by FROM documents)"


@query("p23_provenance_rules", o(f""", {_PROV} SELECT doc_id, code FROM (SELECT doc_id, unnest(list_filter([
  CASE WHEN origin = 'other' THEN 'unknown-origin' END, CASE WHEN origin = 'wordpress' AND source_id IS NULL THEN 'wordpress-without-id' END, CASE WHEN origin = 'wordpress' AND captured_at IS NULL THEN 'wordpress-without-date' END,
  CASE WHEN source_id = '0' THEN 'bad-id' END, CASE WHEN origin = 'derived' AND derived_by IS NULL THEN 'derived-without-author' END, CASE WHEN origin <> 'derived' AND derived_by IS NOT NULL THEN 'author-without-derived' END], lambda x: x IS NOT NULL)) AS code FROM prov)"""))
def p23(spark, d):
    m = F.col("doc_id") % 5
    t = B.table(spark, d, "documents").select(
        "doc_id", F.when(m == 0, "wordpress").when(m == 1, "authored").when(m == 2, "derived").when(m == 3, "sample").otherwise("other").alias("origin"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 50).cast("string")).alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").alias("captured_at"), F.when(F.col("doc_id") % 7 < 3, "x").alias("derived_by"),
    )
    return R.findings(t, "doc_id", R.provenance_rules())


@query("p25_review_only", o("SELECT page_id FROM live WHERE family NOT IN ('media', 'query-variant') AND string_split(path, '/')[2] <> 'es'"))
def p25(spark, d):
    return B.live(spark, d).filter(~F.col("family").isin("media", "query-variant") & (U.segments(U.path_part(F.col("key")))[0] != "es")).select("page_id")


@query("u01_union_kinds", o("SELECT 'post' AS kind, slug AS id, locale FROM posts UNION ALL SELECT 'page', key, NULL FROM live"))
def u01(spark, d):
    a = B.posts(spark, d).select(F.lit("post").alias("kind"), F.col("slug").alias("id"), "locale")
    return a.unionByName(B.live(spark, d).select(F.lit("page").alias("kind"), F.col("key").alias("id")), allowMissingColumns=True)


@query("u02_union_distinct", o("SELECT key FROM live UNION SELECT key FROM local"))
def u02(spark, d):
    return B.live(spark, d).select("key").union(B.local(spark, d).select("key")).distinct()


@query("u03_intersect_all", o("SELECT t AS tag FROM (SELECT locale, unnest(tags) AS t FROM posts) GROUP BY t HAVING count(DISTINCT locale) = (SELECT count(DISTINCT locale) FROM posts)"))
def u03(spark, d):
    p = B.posts(spark, d)
    n = p.agg(F.countDistinct("locale").alias("n"))
    return p.select("locale", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("locale").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("tag")


@query("u04_shared_left_order", o("SELECT doc_id, array_to_string(list_filter(tags, lambda x: list_contains(['t1', 't2', 't3', 't4', 't5', 't6'], x)), ',') AS shared FROM posts"))
def u04(spark, d):
    from ..operators.identity import shared_values

    right = F.array(*[F.lit(f"t{i}") for i in range(1, 7)])
    return B.posts(spark, d).select("doc_id", F.array_join(shared_values(F.col("tags"), right), ",").alias("shared"))


@query("u05_except_all", o("SELECT locale, t AS tag FROM (SELECT locale, unnest(tags) AS t FROM posts WHERE doc_id % 2 = 0) EXCEPT ALL SELECT locale, t FROM (SELECT locale, unnest(tags) AS t FROM posts WHERE doc_id % 2 = 1)"))
def u05(spark, d):
    p = B.posts(spark, d).select("doc_id", "locale", F.explode("tags").alias("tag"))
    return p.filter("doc_id % 2 = 0").select("locale", "tag").exceptAll(p.filter("doc_id % 2 = 1").select("locale", "tag"))


@query("u06_distinct_sorted", o("SELECT DISTINCT author FROM posts ORDER BY author"))
def u06(spark, d):
    return B.posts(spark, d).select("author").distinct().orderBy("author")


@query("u07_core_and_user_taxonomies", o("SELECT * FROM (VALUES ('category', true), ('tag', false)) t(name, hierarchical) UNION ALL SELECT lower(r_name), r_regionkey % 2 = 0 FROM region"))
def u07(spark, d):
    core = spark.createDataFrame([("category", True), ("tag", False)], "name string, hierarchical boolean")
    return core.unionByName(B.table(spark, d, "region").select(F.lower("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("hierarchical")))


@query("u08_sitemap_sources", o("SELECT '/' AS path, NULL::VARCHAR AS lastmod UNION ALL SELECT '/' || slug || '/', published::VARCHAR FROM posts UNION ALL SELECT DISTINCT '/author/' || author || '/', NULL FROM posts"))
def u08(spark, d):
    p = B.posts(spark, d)
    none = F.lit(None).cast("string").alias("lastmod")
    home = spark.range(1).select(F.lit("/").alias("path"), none)
    lists = p.select(F.concat(F.lit("/author/"), F.col("author"), F.lit("/")).alias("path")).distinct().select("path", none)
    return home.unionByName(p.select(F.concat(F.lit("/"), F.col("slug"), F.lit("/")).alias("path"), F.col("published").cast("string").alias("lastmod"))).unionByName(lists)


@query("n03_strict_rules", o(r"""SELECT doc_id, code FROM (SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}$') THEN 'bad-locale' END, CASE WHEN n_chars < 300 THEN 'short-body' END, CASE WHEN length(string_split(text, chr(10))[1]) > 400 THEN 'long-title' END, CASE WHEN source IN ('src1', 'src2') THEN 'unknown-author' END], lambda x: x IS NOT NULL)) AS code FROM documents)"""))
def n03(spark, d):
    t = B.table(spark, d, "documents")
    return R.findings(t, "doc_id", [("bad-locale", ~F.col("lang").rlike("^[a-z]{2}$")), ("short-body", F.col("n_chars") < 300), ("long-title", F.length(F.split("text", "\n", 2)[0]) > 400), ("unknown-author", F.col("source").isin("src1", "src2"))])


@query("k08_redirect_lines", o("SELECT from_path || ' ' || to_path || ' 301' AS line FROM rules UNION ALL SELECT prefix || '/* /:splat 301' FROM splats"))
def k08(spark, d):
    s = spark.createDataFrame(list(B.SPLATS), "prefix string, ord int")
    return B.rules(spark, d).select(F.concat_ws(" ", "from_path", "to_path", F.lit("301")).alias("line")).unionByName(s.select(F.concat(F.col("prefix"), F.lit("/* /:splat 301")).alias("line")))
