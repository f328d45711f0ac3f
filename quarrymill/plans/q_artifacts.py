"""Lines of the artifacts that sources.artifacts publishes, in their global order and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..sources import artifacts as A
from . import bridge as B
from .bridge import oracle as o
from .q_join import _DIFF, diffed
from .registry import query

ORIGIN = "https://new.example"


@query("k06_sitemap_xml", o(f"""SELECT (n // 300 + 1)::BIGINT AS file, n % 300 AS pos, key, line FROM (SELECT '/' || slug || '/' AS key, '  <url><loc>{ORIGIN}/' || slug || '/</loc>' || CASE WHEN doc_id % 3 > 0 THEN '<lastmod>' || strftime(published, '%Y-%m-%d') || '</lastmod>' ELSE '' END || '</url>' AS line,
  row_number() OVER (ORDER BY '/' || slug || '/') - 1 AS n FROM posts)"""))
def k06(spark, d):
    """Sitemaps of 300 locations: the bound is the artifact's own."""
    t = B.posts(spark, d).select(F.concat(F.lit("/"), "slug", F.lit("/")).alias("path"), F.when(F.col("doc_id") % 3 > 0, F.date_format("published", "yyyy-MM-dd")).alias("lastmod"))
    return A.sharded(A.sitemap_rows(t, ORIGIN), A.sitemap_form(ORIGIN, 300))


@query("k05_manifest", o("SELECT path AS key, '    {\"path\":' || to_json(path) || ',\"file\":' || to_json(CASE WHEN trim(path, '/') = '' THEN 'index.html' WHEN trim(path, '/') = '404' THEN '404.html' ELSE trim(path, '/') || '/index.html' END) || ',\"kind\":\"page\",\"origin\":' || to_json(family) || '}' AS line FROM live WHERE key NOT LIKE '%?%'"))
def k05(spark, d):
    path = U.path_part(F.col("key"))
    t = B.live(spark, d).filter("key not like '%?%'").select(path.alias("path"), U.page_file(path).alias("file"), F.lit("page").alias("kind"), F.col("family").alias("origin"))
    return A.manifest_rows(t)


@query("k09_search_index", o("""SELECT 'posts/' || slug AS key, md5('    {"id":' || to_json('posts/' || slug) || ',"kind":"post","title":' || to_json(title) || ',"summary":' || to_json(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'))) || ',"url":' || to_json('/' || slug || '/') || ',"categories":' || to_json(categories) || ',"tags":' || to_json(tags) || '}') AS digest FROM posts"""))
def k09(spark, d):
    """Every post's entry with its title, its first line as summary, and its terms."""
    p = B.posts(spark, d).select(F.concat(F.lit("posts/"), "slug").alias("id"), F.lit("post").alias("kind"), "title", T.squash(F.col("title")).alias("summary"), F.concat(F.lit("/"), "slug", F.lit("/")).alias("url"), "categories", "tags")
    return A.search_rows(p).select("key", F.md5("line").alias("digest"))


@query("k03_diff_report", o(_DIFF + """ SELECT classification || ' 0' AS key, '## ' || classification || ' (' || count(*) || ')' AS line FROM diff GROUP BY classification
UNION ALL SELECT classification || ' 1 ' || key, '- `' || key || '`' || CASE WHEN redirect_target IS NOT NULL THEN ' → `' || redirect_target || '`' ELSE '' END FROM diff"""))
def k03(spark, d):
    return A.diff_report_rows(diffed(spark, d))


@query("k12_seo_overrides", o(r"""SELECT key AS key, '  {"path":' || to_json(key) || ',"locale":' || to_json(lang) || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END || CASE WHEN page_id % 6 = 1 THEN ',"robots":{"noindex":true}' ELSE '' END || '}' AS line
FROM (SELECT key, page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CASE WHEN page_id % 4 > 0 THEN trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) END AS title FROM live JOIN pages USING (page_id)) WHERE page_id % 6 = 1 OR title IS NOT NULL"""))
def k12(spark, d):
    """Heads as captured from the pages: some say nothing of their own, some keep robots out."""
    t = B.live(spark, d).select("page_id", "key").join(B.pages(spark, d).select("page_id", "html"), "page_id")
    none = F.lit(None).cast("string")
    heads = t.select(F.col("key").alias("path"), H.html_lang(F.col("html")).alias("locale"), F.when(F.col("page_id") % 4 > 0, H.title_of(F.col("html"))).alias("title"), none.alias("description"), none.alias("canonical"), (F.col("page_id") % 6 == 1).alias("noindex"), none.alias("problem"))
    return A.overrides(heads)[0]
