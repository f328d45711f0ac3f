"""Entries made from documents against the schema of posts, every rule by its name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract as C
from . import bridge as B
from .bridge import oracle as o
from .q_scalar import _ASSET
from .registry import query

SITE = C.Site(("en", "de", "fr", "es"), "en", B.MEDIA)


def _entries(spark, d):
    """at, fields: a document's own title, language and source, and keys that some lack or have wrongly."""
    i = F.col("doc_id")
    p = B.posts(spark, d).join(B.assets(spark, d), "doc_id")
    wp = i % 3 == 0
    values = {
        "slug": F.when(i % 11 == 0, F.concat(F.lit("Doc "), i)).otherwise(F.col("slug")), "title": F.col("title"), "locale": F.col("locale"), "cluster": F.when(i % 19 == 0, "posts").otherwise(F.concat(F.lit("posts/doc-"), "cluster")),
        "updatedAt": F.when(i % 13 == 0, "2026-02-30").otherwise(F.date_format("published", "yyyy-MM-dd")), "publishedAt": F.when(i % 7 > 0, F.date_format("published", "yyyy-MM-dd")), "author": F.col("author"), "source.system": F.when(wp, "wordpress").when(i % 23 == 1, "moon").otherwise("authored"),
        "source.sourceId": F.when(wp & (i % 4 > 0), F.when(i % 5 == 0, "a-slug").otherwise(F.concat(F.lit("9"), i))), "source.capturedAt": F.when(wp & (i % 9 > 0), "2026-01-01"), "colour": F.when(i % 17 == 0, "red"), "featuredImage.url": F.col("raw"), "featuredImage.width": (i % 3).cast("string"),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.array(v).alias("v")) for k, v in values.items()]), lambda e: e["v"][0].isNotNull())
    many = F.array(F.struct(F.lit("categories").alias("k"), F.when(i % 29 == 0, F.array().cast("array<string>")).otherwise(F.col("categories")).alias("v")), F.struct(F.lit("tags").alias("k"), F.col("tags").alias("v")))
    return p.select(F.col("doc_id").alias("at"), F.map_from_entries(F.concat(pairs, many)).alias("fields"))


_RULES = [
    ("bad-slug", "slug", "i % 11 = 0"), ("bad-text", "title", "title = ''"), ("missing", "title", "title IS NULL"), ("missing", "locale", "locale IS NULL"), ("bad-locale", "locale", "locale NOT IN ('en', 'de', 'fr', 'es')"), ("bad-cluster", "cluster", "i % 19 = 0"), ("bad-date", "updatedAt", "i % 13 = 0"),
    ("missing", "publishedAt", "i % 7 = 0"), ("missing", "author", "author IS NULL"), ("bad-slug", "author", "NOT regexp_matches(author, '^[\\p{Ll}\\p{Lo}\\p{Lm}\\p{N}\\p{M}_]+(-[\\p{Ll}\\p{Lo}\\p{Lm}\\p{N}\\p{M}_]+)*$')"), ("bad-choice", "source.system", "i % 3 > 0 AND i % 23 = 1"),
    ("wordpress-without-identity", "source.sourceId", "i % 3 = 0 AND (i % 4 = 0 OR i % 9 = 0)"), ("source-id-is-no-key", "source.sourceId", "i % 3 = 0 AND (i % 4 = 0 OR i % 5 = 0)"), ("unknown-key", "colour", "i % 17 = 0"), ("missing", "categories", "i % 29 = 0"), ("bad-count", "featuredImage.width", "i % 3 = 0"),
    ("bad-media", "featuredImage.url", "NOT (classification IN ('SUPPORTED', 'CONFIGURED') OR classification = 'EXTERNAL' AND raw ILIKE 'https://%' AND NOT contains(raw, '/wp-content/uploads/'))"),
]


@query("n03_entry_schema", o(_ASSET + ", es AS MATERIALIZED (SELECT p.doc_id AS i, title, locale, author, raw, classification FROM posts p JOIN asset_ids USING (doc_id)) " + " UNION ALL ".join(f"SELECT i AS \"at\", '{c}' AS code, '{k}' AS detail FROM es WHERE {w}" for c, k, w in _RULES)))
def n03_schema(spark, d):
    return C.schema_findings(_entries(spark, d), "posts", SITE)
