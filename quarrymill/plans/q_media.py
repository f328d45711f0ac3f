"""Media of a content tree: discovery, plan, verification and manifest, over texts and nested registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.url import MediaProfile
from ..operators import media as M
from . import bridge as B
from .bridge import oracle as o
from .registry import query

PROFILE = MediaProfile(hosts=("site.example", "cdn.example"), extra=("files",))


def _tree(spark, d):
    """(entries, registries): documents with pictures, front matter and the markup of pages; suppliers as JSON that nests urls."""
    raws = B.assets(spark, d)
    i = F.col("doc_id").cast("string")
    html = B.pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("html").alias("h"))
    front = F.concat(F.lit("---\nslug: d"), i, F.lit('\nimage:\n  url: "'), "raw", F.lit('"\n  variants:\n    - url: /wp-content/uploads/v/'), i, F.lit(".png\n---\n"))
    body = F.concat(F.lit('<img src="'), "raw", F.lit('">'), F.coalesce("h", F.lit("")), F.coalesce("text", F.lit("")))
    t = B.table(spark, d, "documents").select("doc_id", "text").join(raws, "doc_id").join(html, "doc_id", "left")
    entries = t.select(F.concat(F.lit("posts/"), i, F.lit(".md")).alias("file"), F.concat(front, body).alias("text"))
    s = raws.join(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name"), "doc_id")
    row = F.struct(
        F.col("s_name").alias("slug"), F.struct(F.col("raw").alias("url"), F.array(F.struct(F.concat(F.lit("https://cdn.example/wp-content/uploads/2026/"), F.col("doc_id") % 40, F.lit(".png")).alias("url"), F.lit(3).alias("width"))).alias("variants")).alias("avatar"),
        F.array(F.col("raw"), F.lit("x")).alias("links"), F.concat(F.lit("/files/"), i).alias("siteurl"),
    )
    registries = s.select(F.concat(F.lit("r"), i, F.lit(".json")).alias("file"), F.when(F.col("doc_id") % 50 == 3, "{broken").otherwise(F.to_json(F.array(row))).alias("text"))
    return entries, registries


def _found(spark, d):
    return M.found(*_tree(spark, d), PROFILE)


def _captured(spark, d):
    """Most of the planned files, and a few that nothing names."""
    raws = B.assets(spark, d).filter("doc_id % 3 <> 0").select(F.concat(F.lit("media/v/"), "doc_id", F.lit(".png")).alias("file"))
    return raws.unionByName(B.table(spark, d, "nation").select(F.concat(F.lit("media/orphan/"), "n_nationkey", F.lit(".png")).alias("file")))


_SQL = r"""
front AS (SELECT 'posts/' || doc_id || '.md' AS file, 'front-matter url' AS field, unnest([raw, '/wp-content/uploads/v/' || doc_id || '.png']) AS url FROM documents JOIN assets USING (doc_id)),
body AS (SELECT 'posts/' || d.doc_id || '.md' AS file, '<img src="' || raw || '">' || coalesce(html, '') || coalesce(text, '') AS t FROM documents d JOIN assets USING (doc_id) LEFT JOIN pages ON page_id = d.doc_id),
attr AS (SELECT file, unnest(regexp_extract_all(t, '(?i)\b(?:src|href)=(?:"[^"'']*"|''[^"'']*'')')) AS a FROM body),
inline AS (SELECT file, lower(regexp_extract(a, '^([A-Za-z]+)', 1)) AS field, trim(regexp_replace(a, '(?i)^[a-z]+=', ''), '"''') AS url FROM attr),
reg AS (SELECT 'r' || a.doc_id || '.json' AS file, CASE WHEN a.doc_id % 50 = 3 THEN NULL ELSE json_array(json_object('slug', s_name, 'avatar', json_object('url', raw, 'variants', json_array(json_object('url', 'https://cdn.example/wp-content/uploads/2026/' || a.doc_id % 40 || '.png', 'width', 3))), 'links', json_array(raw, 'x'), 'siteurl', '/files/' || a.doc_id)) END AS j FROM assets a JOIN supplier ON s_suppkey = a.doc_id),
nested AS (SELECT file, substr(fullkey, 2) AS field, json_extract_string(atom, '$') AS url FROM reg, json_tree(j) WHERE j IS NOT NULL AND type = 'VARCHAR' AND fullkey LIKE '%url' UNION ALL SELECT file, 'invalid-json', NULL FROM reg WHERE j IS NULL),
raws AS (SELECT * FROM front UNION ALL SELECT * FROM inline WHERE url <> '' UNION ALL SELECT * FROM nested),
m1 AS (SELECT *, regexp_extract(url, '^([^?#]*)', 1) AS p FROM raws),
m2 AS (SELECT *, regexp_replace(lower(regexp_extract(regexp_replace(p, '^//', 'https://'), '^https?://([^/]*)', 1)), '^www\.', '') AS host, regexp_replace(p, '^(https?:)?//[^/]*', '') AS inner_ FROM m1),
m3 AS (SELECT *, CASE WHEN url IS NULL THEN NULL WHEN url LIKE '#%' OR regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches(url, '(?i)^https?:') THEN 'UNSUPPORTED'
  WHEN host <> '' AND host NOT IN ('site.example', 'cdn.example') THEN 'EXTERNAL' WHEN inner_ LIKE '/wp-content/uploads/%' THEN CASE WHEN inner_ LIKE '%/' OR inner_ LIKE '%/../%' THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END
  WHEN inner_ LIKE '/files/%' THEN 'CONFIGURED' WHEN inner_ LIKE '/media/%' THEN 'SUPPORTED' WHEN host <> '' THEN 'EXTERNAL' ELSE 'UNSUPPORTED' END AS classification FROM m2),
media AS MATERIALIZED (SELECT file, field, url, host, classification, CASE WHEN classification IN ('SUPPORTED', 'CONFIGURED') THEN 'uploads:' || regexp_replace(inner_, '^/(wp-content/uploads|files|media)/', '') END AS key FROM m3
  WHERE field <> 'href' OR classification IN ('SUPPORTED', 'CONFIGURED'))"""
_PLAN = ", planned AS (SELECT key, 'media/' || substr(key, 9) AS file, count(*) AS n, list_sort(list_distinct(list(host) FILTER (host <> ''))) AS hosts FROM media WHERE key IS NOT NULL GROUP BY key)"


@query("s20_media_references", o(f", {_SQL} SELECT file, field, url, classification, key FROM media"))
def s20(spark, d):
    return _found(spark, d).select("file", "field", "url", "asset.classification", "asset.key")


@query("g11_media_discover", o(f", {_SQL}, c AS (SELECT classification, count(*) AS n, count(DISTINCT url) AS urls FROM media GROUP BY 1) SELECT t.c AS classification, coalesce(n, 0)::BIGINT AS n, coalesce(urls, 0)::BIGINT AS urls FROM (VALUES ('SUPPORTED'), ('CONFIGURED'), ('EXTERNAL'), ('UNSUPPORTED'), ('MISSING'), ('CONFLICT')) t(c) LEFT JOIN c ON c.classification = t.c"))
def g11_discover(spark, d):
    return M.discover(_found(spark, d))


@query("g11_media_verify", o(f""", {_SQL}{_PLAN}, captured AS (SELECT 'media/v/' || doc_id || '.png' AS file FROM assets WHERE doc_id % 3 <> 0 UNION ALL SELECT 'media/orphan/' || n_nationkey || '.png' FROM nation)
SELECT 'MISSING' AS code, key, file AS detail FROM planned WHERE file NOT IN (SELECT file FROM captured) UNION ALL SELECT 'CONFLICT', key, array_to_string(hosts, ' and ') FROM planned WHERE len(hosts) > 1
UNION ALL SELECT 'UNCLAIMED', file, '' FROM captured WHERE file NOT IN (SELECT file FROM planned)"""))
def g11_verify(spark, d):
    return M.verify(_found(spark, d), _captured(spark, d))


@query("k10_media_manifest", o(f""", {_SQL} SELECT 'assets' AS section, key AS name, '/media/' || substr(key, 9) AS local, count(*) AS n FROM media WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'references', classification, NULL, count(*) FROM media WHERE classification IS NOT NULL GROUP BY 2 UNION ALL SELECT 'hosts', host, NULL, count(*) FROM media WHERE classification = 'EXTERNAL' AND host <> '' GROUP BY 2
UNION ALL SELECT 'unsupported', url, NULL, count(*) FROM media WHERE classification = 'UNSUPPORTED' GROUP BY 2"""))
def k10(spark, d):
    return M.manifest(_found(spark, d))


@query("x04_collected_media", o(f", {_SQL} SELECT file, array_to_string(list_sort(list_distinct(list(trim(url)))), ' ') AS urls FROM media WHERE field IN ('src', 'href') AND key IS NOT NULL AND file LIKE 'posts/%' GROUP BY file"))
def x04(spark, d):
    """Documents that name media of the site's own, with what they name."""
    entries, _ = _tree(spark, d)
    t = entries.select("file", M.collected(F.expr("substring(text, locate('\\n---\\n', text, 4) + 5)"), PROFILE).alias("urls"))
    return t.filter(F.size("urls") > 0).select("file", F.array_join("urls", " ").alias("urls"))
