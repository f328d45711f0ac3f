"""Lineage of a build made from documents, authors and terms: the table and the three lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from . import bridge as B
from .bridge import oracle as o
from .registry import query


def _edges(spark, d):
    """Posts that content claims from the source, terms that derive archives of several pages, routes of most of them."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    posts = B.posts(spark, d).select("doc_id", F.concat(F.lit("posts/"), "slug", F.lit("@"), F.coalesce("locale", F.lit(""))).alias("id"), "locale", "slug")
    terms = B.terms(spark, d)
    said = posts.select("id", F.when(i % 3 == 0, "authored").otherwise("wordpress").alias("origin"), none.alias("source"), F.lit("posts").alias("collection"), "locale", none.alias("declared_by"), F.concat(F.lit("/"), "slug", F.lit("/")).alias("expected_route"))
    archives = terms.select(F.concat(F.lit("terms/"), "slug").alias("id"), F.lit("derived").alias("origin"), none.alias("source"), none.alias("collection"), none.alias("locale"), F.lit("taxonomies").alias("declared_by"), none.alias("expected_route"))
    claims = posts.filter("doc_id % 3 > 0").select("id", F.lit("wordpress").alias("origin"), F.concat(F.lit("wp:post/post#"), (i % 400).cast("string"), F.lit("@"), F.coalesce("locale", F.lit(""))).alias("source"), F.lit("posts").alias("collection"), "locale", none.alias("declared_by"), i.alias("pos"))
    own = posts.filter("doc_id % 5 > 0").select(F.concat(F.lit("/"), "slug", F.lit("/")).alias("path"), F.concat("slug", F.lit("/index.html")).alias("file"), F.col("id").alias("entry"))
    listed = terms.select("slug", F.explode(F.sequence(F.lit(1), F.length("slug"))).alias("n")).select(F.concat(F.lit("/t/"), "slug", F.lit("/page/"), "n", F.lit("/")).alias("path"), F.concat(F.lit("t/"), "slug", F.lit("/page/"), "n", F.lit("/index.html")).alias("file"), F.concat(F.lit("terms/"), "slug").alias("entry"))
    return P.edges(said.unionByName(archives), own.unionByName(listed), claims)


_SQL = """
pp AS (SELECT doc_id, 'posts/' || slug || '@' || coalesce(locale, '') AS id, locale, slug FROM posts),
ln AS MATERIALIZED (SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'authored' ELSE 'wordpress' END AS origin, CASE WHEN doc_id % 3 > 0 THEN 'wp:post/post#' || doc_id % 400 || '@' || coalesce(locale, '') END AS source, 'posts' AS collection, locale, NULL::VARCHAR AS declared_by, '/' || slug || '/' AS expected_route,
  (doc_id % 5 > 0)::BIGINT AS n_routes, CASE WHEN doc_id % 5 > 0 THEN '/' || slug END AS route, CASE WHEN doc_id % 5 > 0 THEN slug || '/index.html' END AS output FROM pp
  UNION ALL SELECT 'terms/' || slug, 'derived', NULL, NULL, NULL, 'taxonomies', NULL, length(slug), '/t/' || slug || '/page/1', 't/' || slug || '/page/1/index.html' FROM terms)"""


@query("g12_provenance", o(f", {_SQL} SELECT *, n_routes = 0 AS withheld FROM ln"))
def g12(spark, d):
    return P.lineage(_edges(spark, d))


@query("g12_by_route", o(f", {_SQL}, asked AS (SELECT '/' || slug || '//' AS subject FROM pp UNION ALL SELECT '/t/' || slug || '/page/2' FROM terms UNION ALL SELECT '/nowhere'), rt AS (SELECT route, id FROM ln WHERE declared_by IS NULL AND route IS NOT NULL UNION ALL SELECT '/t/' || slug || '/page/' || n, 'terms/' || slug FROM (SELECT slug, unnest(range(1, length(slug) + 1)) AS n FROM terms)) SELECT subject, max(id) AS id FROM asked LEFT JOIN rt ON rt.route = rtrim(subject, '/') GROUP BY subject"))
def g12_route(spark, d):
    p, t = B.posts(spark, d), B.terms(spark, d)
    asked = p.select(F.concat(F.lit("/"), "slug", F.lit("//")).alias("subject")).unionByName(t.select(F.concat(F.lit("/t/"), "slug", F.lit("/page/2")).alias("subject"))).unionByName(spark.createDataFrame([("/nowhere",)], "subject string"))
    return P.lookup(_edges(spark, d), "route", asked)


@query("g12_by_output", o(f", {_SQL}, asked AS (SELECT '/' || slug || '/index.html' AS subject FROM pp) SELECT subject, id FROM asked LEFT JOIN ln ON output = ltrim(subject, '/')"))
def g12_output(spark, d):
    return P.lookup(_edges(spark, d), "output", B.posts(spark, d).select(F.concat(F.lit("/"), "slug", F.lit("/index.html")).alias("subject")))


@query("g12_by_source", o(f", {_SQL}, asked AS (SELECT DISTINCT 'wp:post/post#' || doc_id % 500 || '@en' AS subject FROM pp) SELECT subject, id FROM asked LEFT JOIN ln ON source = subject"))
def g12_source(spark, d):
    asked = B.posts(spark, d).select(F.concat(F.lit("wp:post/post#"), (F.col("doc_id") % 500).cast("string"), F.lit("@en")).alias("subject")).distinct()
    return P.lookup(_edges(spark, d), "source", asked)


@query("k14_provenance_table", o(f", {_SQL} SELECT count(*) AS entities, count(*) FILTER (origin = 'wordpress') AS wordpress, count(*) FILTER (origin = 'derived') AS derived, count(*) FILTER (n_routes > 0) AS published, count(*) FILTER (n_routes = 0) AS withheld FROM ln"))
def k14(spark, d):
    return P.summary(P.lineage(_edges(spark, d)))
