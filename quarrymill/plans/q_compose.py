"""Composite queries: the gates as chains of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import discovery as S
from ..operators import rules as R
from ..operators import transform as X
from . import bridge as B
from .q_aggregate import _CAP, captured
from .q_join import _DIFF, diffed
from .registry import query

o = B.oracle


@query("g01_route_table", o("""SELECT kind, path, count(*)::BIGINT AS claims FROM (SELECT 'post' AS kind, '/' || slug || '/' AS path FROM posts UNION ALL SELECT 'author', '/author/' || author || '/' FROM (SELECT DISTINCT author FROM posts) UNION ALL SELECT 'category', '/category/' || c || '/' FROM (SELECT DISTINCT unnest(categories) AS c FROM posts)
UNION ALL SELECT 'tag', '/tag/' || t || '/' FROM (SELECT DISTINCT unnest(tags) AS t FROM posts) UNION ALL SELECT 'listing', CASE WHEN n = 1 THEN '/blog/' ELSE '/blog/page/' || n || '/' END FROM (SELECT unnest(range(1, (SELECT greatest(1, ceil(count(*) / 10))::BIGINT FROM posts) + 1)) AS n)) GROUP BY ALL"""))
def g01(spark, d):
    p = B.posts(spark, d)
    L = B.LINKS
    posts = p.select(F.lit("post").alias("kind"), U.expand(L.post, postname=F.col("slug")).alias("path"))
    authors = p.select("author").distinct().select(F.lit("author").alias("kind"), U.expand(L.author, nicename=F.col("author")).alias("path"))
    cats = p.select(F.explode("categories").alias("c")).distinct().select(F.lit("category").alias("kind"), U.expand(L.category, slug=F.col("c")).alias("path"))
    tags = p.select(F.explode("tags").alias("c")).distinct().select(F.lit("tag").alias("kind"), U.expand(L.tag, slug=F.col("c")).alias("path"))
    pages = p.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / L.per_page)).cast("int").alias("n")).select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("n"))
    lists = pages.select(F.lit("listing").alias("kind"), U.paginated(F.lit(L.posts_index), F.col("n"), L.pagination).alias("path"))
    return posts.unionByName(authors).unionByName(cats).unionByName(tags).unionByName(lists).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("claims"))


_TERMS = "list_distinct(list_filter(string_split(regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_HIT = "CASE WHEN len(list_filter(ft, lambda x: starts_with(x, '{w}'))) > 0 THEN 4 WHEN len(list_filter(fc, lambda x: starts_with(x, '{w}'))) > 0 THEN 3 WHEN len(list_filter(fg, lambda x: starts_with(x, '{w}'))) > 0 THEN 2 WHEN len(list_filter(fs, lambda x: starts_with(x, '{w}'))) > 0 THEN 1 ELSE 0 END"
_ANY = "len(list_filter({f}, lambda x: starts_with(x, 'the') OR starts_with(x, 't1'))) > 0"


@query("g02_search", o(f""", dx AS (SELECT slug AS id, published, {_TERMS.format(x='title')} AS ft, categories AS fc, tags AS fg, {_TERMS.format(x='body')} AS fs FROM posts WHERE locale = 'en'),
sx AS (SELECT id, published, {_HIT.format(w='the')} AS s1, {_HIT.format(w='t1')} AS s2, array_to_string(list_filter([CASE WHEN {_ANY.format(f='ft')} THEN 'title' END, CASE WHEN {_ANY.format(f='fc')} THEN 'categories' END, CASE WHEN {_ANY.format(f='fg')} THEN 'tags' END, CASE WHEN {_ANY.format(f='fs')} THEN 'summary' END], lambda x: x IS NOT NULL), ',') AS matched FROM dx)
SELECT id, s1 + s2 AS score, matched, row_number() OVER (ORDER BY s1 + s2 DESC, published DESC, id) AS rank FROM sx WHERE s1 > 0 AND s2 > 0 ORDER BY rank LIMIT 50"""))
def g02(spark, d):
    p = B.posts(spark, d).select(F.col("slug").alias("id"), "title", F.col("body").alias("summary"), "categories", "tags", "locale", F.col("published").alias("date"))
    return S.search(p, "the t1", "en", 50)


@query("g03_seo_audit", o(r""", hd AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)) AS title FROM pages)
SELECT page_id, 'title-too-long' AS code FROM hd WHERE length(title) > 60 UNION ALL SELECT page_id, 'title-missing' FROM hd WHERE title = '' UNION ALL SELECT page_id, 'description-missing' FROM hd UNION ALL SELECT page_id, 'canonical-missing' FROM hd
UNION ALL SELECT min(page_id), 'title-shared' FROM hd WHERE title <> '' GROUP BY title HAVING count(*) > 1"""))
def g03(spark, d):
    return R.seo_findings(B.pages(spark, d), "page_id", "html")


@query("g06_site_map_audit", o(_DIFF + " SELECT classification, family, count(*)::BIGINT AS n FROM diff GROUP BY ALL"))
def g06(spark, d):
    return diffed(spark, d).groupBy("classification", "family").agg(F.count(F.lit(1)).alias("n"))


@query("g10_transform", o(f", {_CAP} SELECT id, reason FROM ladder"))
def g10(spark, d):
    return X.ladder(captured(spark, d)).select("id", "reason")


@query("g10_exclusions", o(f", {_CAP} SELECT coalesce(reason, 'made') AS reason, count(*)::BIGINT AS n FROM ladder GROUP BY 1"))
def g10b(spark, d):
    return X.ladder(captured(spark, d)).groupBy(F.coalesce("reason", F.lit("made")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("n05_intended_content", o("SELECT 'posts/' || slug || '@' || locale AS id, '/' || slug || '/' AS route FROM posts UNION ALL SELECT 'authors/' || author, '/author/' || author || '/' FROM (SELECT DISTINCT author FROM posts) UNION ALL SELECT 'terms/' || slug, CASE WHEN parent IS NULL THEN NULL ELSE '/topics/' || slug || '/' END FROM terms"))
def n05(spark, d):
    p = B.posts(spark, d)
    a = p.select(U.entry_id(F.lit("posts"), F.col("slug"), F.col("locale")).alias("id"), U.expand(B.LINKS.post, postname=F.col("slug")).alias("route"))
    b = p.select("author").distinct().select(F.concat(F.lit("authors/"), F.col("author")).alias("id"), U.expand(B.LINKS.author, nicename=F.col("author")).alias("route"))
    c = B.terms(spark, d).select(F.concat(F.lit("terms/"), F.col("slug")).alias("id"), F.when(F.col("parent").isNotNull(), U.expand("/topics/%slug%/", slug=F.col("slug"))).alias("route"))
    return a.unionByName(b).unionByName(c)


@query("n01_json_ld", o("""SELECT doc_id, '{"@type":"BlogPosting","headline":' || to_json(title)::VARCHAR || ',"datePublished":"' || strftime(published, '%Y-%m-%d') || '"}' AS json FROM posts"""))
def n01(spark, d):
    p = B.posts(spark, d)
    return p.select("doc_id", F.to_json(F.struct(F.lit("BlogPosting").alias("@type"), F.col("title").alias("headline"), F.date_format("published", "yyyy-MM-dd").alias("datePublished"))).alias("json"))
