"""Relations of a content migration, projected from the driver's tables by integer arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U

LINKS = U.Permalinks(languages=("de", "fr"))
SPLATS = (("/de", 1), ("/fr", 2))
RETIRED = ("media",)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def live(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, key, family; one row a key, the first page's."""
    p = table(spark, d, "pages").select("page_id", "url", U.comparison_key(F.col("url")).alias("key"))
    one = p.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("x")).select("x.page_id", "x.url", "key")
    return one.withColumn("family", U.classify_family(F.col("key"), LINKS))


def local(spark: SparkSession, d: str) -> DataFrame:
    """key, file, redirect."""
    t = live(spark, d)
    own = t.filter("page_id % 3 <> 0").select("key", (F.col("page_id") % 11 == 0).alias("redirect"))
    more = t.filter("page_id % 13 = 0").select(F.concat(U.path_part(F.col("key")), F.lit("extra/")).alias("key"), (F.col("page_id") % 2 == 0).alias("redirect"))
    return own.unionByName(more).groupBy("key").agg(F.min("redirect").alias("redirect")).withColumn("file", U.page_file(U.path_part(F.col("key"))))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """from_path, to_path, ord: one rule a source path."""
    t = live(spark, d).filter("page_id % 7 = 0")
    to = F.when(F.col("page_id") % 5 == 0, "https://elsewhere.example/").otherwise(F.concat(F.lit("/en/"), (F.col("page_id") % 50).cast("string"), F.lit("/")))
    r = t.select(U.trim_slashes(U.path_part(F.col("key"))).alias("from_path"), to.alias("to_path"), F.col("page_id").alias("ord"))
    return r.groupBy("from_path").agg(F.min(F.struct("ord", "to_path")).alias("x")).select("from_path", "x.to_path", "x.ord")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, slug, title, locale, cluster, published, author, categories, tags, body."""
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        F.split("text", "\n", 2)[0].alias("title"),
        F.col("lang").alias("locale"),
        F.floor(F.col("doc_id") / 4).alias("cluster"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published"),
        F.col("source").alias("author"),
        F.array(F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string"))).alias("categories"),
        F.array(F.concat(F.lit("t"), (F.col("doc_id") % 13).cast("string")), F.concat(F.lit("t"), (F.col("doc_id") % 17).cast("string"))).alias("tags"),
        F.col("text").alias("body"),
    )


def terms(spark: SparkSession, d: str) -> DataFrame:
    """slug, parent, name: regions over nations, and one level of customers' segments below some nations."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("slug"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("slug"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    s = table(spark, d, "nation").filter("n_nationkey % 4 = 0").select(F.concat(F.lit("s"), F.col("n_nationkey")).alias("slug"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("parent"), F.concat(F.col("n_name"), F.lit(" local")).alias("name"))
    return r.unionByName(n).unionByName(s)


def broken_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms with an unknown parent, a term that is its own ancestor, and a pair that form a loop."""
    extra = spark.createDataFrame([("x1", "nowhere", "lost"), ("x2", "x2", "self"), ("x3", "x4", "loop a"), ("x4", "x3", "loop b"), ("x5", "x3", "under a loop")], "slug string, parent string, name string")
    return terms(spark, d).unionByName(extra)


def refs(spark: SparkSession, d: str) -> DataFrame:
    """page_id, tag, attribute, raw, pos of the links of pages."""
    p = table(spark, d, "pages").select("page_id", F.posexplode(H.link_references(F.col("html"))).alias("pos", "r"))
    return p.select("page_id", "pos", "r.tag", "r.attribute", "r.raw")


def assets(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, raw: references of every class, spelled from ids."""
    i = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("https://www.Site.example/wp-content/uploads/2026/"), F.col("doc_id") % 40, F.lit(".png?w="), i))
        .when(F.col("doc_id") % 11 == 1, F.concat(F.lit("//site.example/wp-content/uploads/2026/"), F.col("doc_id") % 40, F.lit(".png")))
        .when(F.col("doc_id") % 11 == 2, F.concat(F.lit("/wp-content/uploads/a/"), i, F.lit(".jpg#top")))
        .when(F.col("doc_id") % 11 == 3, F.concat(F.lit("https://cdn.example/wp-content/uploads/"), i, F.lit(".png")))
        .when(F.col("doc_id") % 11 == 4, F.concat(F.lit("http://site.example/files/"), i, F.lit(".pdf")))
        .when(F.col("doc_id") % 11 == 5, F.lit("/wp-content/uploads/dir/"))
        .when(F.col("doc_id") % 11 == 6, F.lit("/wp-content/uploads/../secret.png"))
        .when(F.col("doc_id") % 11 == 7, F.lit("data:image/png;base64,AAAA"))
        .when(F.col("doc_id") % 11 == 8, F.concat(F.lit("/media/"), i, F.lit(".webp")))
        .when(F.col("doc_id") % 11 == 9, F.concat(F.lit("images/"), i, F.lit(".gif")))
        .otherwise(F.lit("#top"))
    )
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


MEDIA = U.MediaProfile(hosts=("site.example",), extra=("files",))

_KEY = r"""CASE WHEN regexp_matches({p}, '\.[A-Za-z0-9]{{1,5}}$') OR {p} LIKE '%/' THEN {p} ELSE {p} || '/' END"""

_FAMILY = r"""CASE
  WHEN query <> '' AND regexp_matches(query, '(^|&)s(=|&|$)') THEN 'search' WHEN query <> '' THEN 'query-variant'
  WHEN seg[1] IN ('de', 'fr') THEN 'translated' WHEN len(seg) = 0 THEN 'front-page'
  WHEN seg[1] IN ('wp-admin', 'wp-json', 'wp-login.php', 'xmlrpc.php') THEN 'wp-internal' WHEN seg[1] IN ('wp-content', 'wp-includes') THEN 'media'
  WHEN path LIKE '%.xml' AND regexp_matches(path, '(?i)sitemap') THEN 'sitemap' WHEN seg[len(seg)] = 'feed' THEN 'feed'
  WHEN regexp_matches(path, '\.[A-Za-z0-9]{1,5}$') THEN 'media' WHEN regexp_matches(path, '/page/\d+/?$') THEN 'pagination'
  WHEN regexp_matches(dated, '^/\d{4}(/\d{2}(/\d{2})?)?/?$') THEN 'date-archive' WHEN path = '/blog/' THEN 'posts-index'
  WHEN regexp_matches(path, '^/category/[^/]+/?$') THEN 'category' WHEN regexp_matches(path, '^/author/[^/]+/?$') THEN 'author' WHEN regexp_matches(path, '^/tag/[^/]+/?$') THEN 'tag'
  WHEN len(seg) = 1 THEN 'entry' ELSE 'page' END"""

#: SQL for the same relations, as common table expressions.
SQL = rf"""
u_ AS (SELECT page_id, url, html, regexp_replace(url, '^https?://[^/?#]*', '') AS rest FROM pages),
v_ AS (SELECT page_id, url, CASE WHEN regexp_extract(rest, '^([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^([^?#]*)', 1) END AS path,
  CASE WHEN regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) END AS query FROM u_),
k_ AS (SELECT page_id, url, {_KEY.format(p="path")} || query AS key, path, query FROM v_),
f_ AS (SELECT arg_min(url, page_id) AS url, min(page_id) AS page_id, key FROM k_ GROUP BY key),
g_ AS (SELECT *, regexp_extract(key, '^([^?#]*)', 1) AS path, regexp_extract(key, '\?([^#]*)', 1) AS query FROM f_),
h_ AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, CASE WHEN starts_with(path, '/blog/') THEN substr(path, 6) ELSE path END AS dated FROM g_),
live AS (SELECT page_id, url, key, path, {_FAMILY} AS family FROM h_),
l_ AS (SELECT key, page_id % 11 = 0 AS redirect FROM live WHERE page_id % 3 <> 0 UNION ALL SELECT path || 'extra/', page_id % 2 = 0 FROM live WHERE page_id % 13 = 0),
local AS (SELECT key, redirect, CASE WHEN t = '' THEN 'index.html' WHEN t = '404' THEN '404.html' ELSE t || '/index.html' END AS file FROM
  (SELECT key, min(redirect) AS redirect, trim(regexp_extract(key, '^([^?#]*)', 1), '/') AS t FROM l_ GROUP BY key)),
lf_ AS (SELECT *, regexp_extract(key, '^([^?#]*)', 1) AS path, regexp_extract(key, '\?([^#]*)', 1) AS query FROM local),
lh_ AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, CASE WHEN starts_with(path, '/blog/') THEN substr(path, 6) ELSE path END AS dated FROM lf_),
local_family AS (SELECT key, redirect, {_FAMILY} AS family FROM lh_),
r_ AS (SELECT CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS from_path, CASE WHEN page_id % 5 = 0 THEN 'https://elsewhere.example/' ELSE '/en/' || (page_id % 50) || '/' END AS to_path, page_id AS ord FROM live WHERE page_id % 7 = 0),
rules AS (SELECT from_path, arg_min(to_path, ord) AS to_path, min(ord) AS ord FROM r_ GROUP BY from_path),
splats AS (SELECT * FROM (VALUES ('/de', 1), ('/fr', 2)) t(prefix, ord)),
posts AS (SELECT doc_id, 'doc-' || doc_id AS slug, string_split(text, chr(10))[1] AS title, lang AS locale, doc_id // 4 AS cluster, DATE '2024-01-01' + (doc_id % 365)::INT AS published, source AS author,
  ['c' || doc_id % 7] AS categories, ['t' || doc_id % 13, 't' || doc_id % 17] AS tags, text AS body FROM documents),
terms AS (SELECT 'r' || r_regionkey AS slug, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || n_nationkey, 'n' || n_nationkey, n_name || ' local' FROM nation WHERE n_nationkey % 4 = 0),
broken_terms AS (SELECT * FROM terms UNION ALL SELECT * FROM (VALUES ('x1', 'nowhere', 'lost'), ('x2', 'x2', 'self'), ('x3', 'x4', 'loop a'), ('x4', 'x3', 'loop b'), ('x5', 'x3', 'under a loop')) t(slug, parent, name)),
links_ AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<[a-z][a-z0-9-]*\b[^>]*>')) AS tag_ FROM pages),
attrs_ AS (SELECT page_id, lower(regexp_extract(tag_, '^<([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag, unnest(regexp_extract_all(tag_, '(?i)\b(?:href|src)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>=`]+)')) AS a_ FROM links_),
refs AS (SELECT * FROM (SELECT page_id, tag, lower(regexp_extract(a_, '^([A-Za-z]+)', 1)) AS attribute, trim(regexp_replace(a_, '(?i)^(href|src)\s*=\s*', ''), '"''') AS raw FROM attrs_) WHERE raw <> ''),
assets AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'https://www.Site.example/wp-content/uploads/2026/' || doc_id % 40 || '.png?w=' || doc_id WHEN 1 THEN '//site.example/wp-content/uploads/2026/' || doc_id % 40 || '.png'
  WHEN 2 THEN '/wp-content/uploads/a/' || doc_id || '.jpg#top' WHEN 3 THEN 'https://cdn.example/wp-content/uploads/' || doc_id || '.png' WHEN 4 THEN 'http://site.example/files/' || doc_id || '.pdf'
  WHEN 5 THEN '/wp-content/uploads/dir/' WHEN 6 THEN '/wp-content/uploads/../secret.png' WHEN 7 THEN 'data:image/png;base64,AAAA' WHEN 8 THEN '/media/' || doc_id || '.webp'
  WHEN 9 THEN 'images/' || doc_id || '.gif' ELSE '#top' END AS raw FROM documents)
"""


def oracle(body: str) -> str:
    """An oracle query over the relations; a body may begin with further common table expressions (", x AS ...")."""
    return f"WITH RECURSIVE {SQL} {body}"
