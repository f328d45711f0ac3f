"""Whole gates: the build audit with its joins, crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..operators import build_audit as A
from ..operators import crawl as W
from ..operators import digest as G
from ..operators import hierarchy as Y
from . import bridge as B
from .bridge import oracle as o
from .registry import query

SITE = A.Site(environment="production", origin="https://new.example", migrated=("site.example",))


def _build(spark, d):
    """inventory, emitted, redirects, overrides, samples: routes are page keys and the targets of menus; artifacts are the pages' markup,
    each with a picture, and a few files."""
    t = B.live(spark, d).withColumn("path", U.trim_slashes(U.path_part(F.col("key")))).filter("key not like '%?%'")
    kind = F.when(F.col("page_id") % 10 == 8, "redirect").when(F.col("page_id") % 10 == 9, "data").otherwise("page")
    words = B.refs(spark, d).filter("tag = 'a' and raw like '/%'").select(F.col("raw").alias("path")).distinct().filter("length(path) % 3 = 0")
    routes = t.select("path", U.page_file(F.col("path")).alias("file"), kind.alias("kind"))
    inventory = routes.unionByName(words.select("path", U.page_file(F.col("path")).alias("file"), F.when(F.length("path") % 2 == 0, "page").otherwise("data").alias("kind")))
    picture = B.assets(spark, d).select(F.col("doc_id").alias("page_id"), F.concat(F.lit('<img src="'), "raw", F.lit('">')).alias("picture"))
    made = t.filter("page_id % 5 <> 0").select("page_id", U.page_file(F.col("path")).alias("file"))
    emitted = made.join(B.pages(spark, d).select("page_id", "html"), "page_id").join(picture, "page_id").select("file", F.concat("html", "picture").alias("text"))
    extra = t.filter("page_id % 13 = 0").select(F.concat(F.lit("extra/"), "page_id", F.lit("/index.html")).alias("file"), F.lit('<html lang="en-GB"><head><meta name="robots" content="noindex"><title>T</title></head><main id="main"><h1>x</h1>This build is coming soon.').alias("text"))
    rules = B.rules(spark, d).select("from_path", "ord")
    stubs = rules.filter("ord % 2 = 0").select(U.page_file(F.col("from_path")).alias("file"), F.lit("<title>moved</title>").alias("text"))
    locs = F.concat(F.lit("<urlset>"), F.repeat(F.lit("<url><loc>x</loc></url>"), F.count_if(F.col("page_id") % 3 == 0).cast("int")))
    single = [("robots.txt", "User-agent: *\nDisallow: /\n"), ("deployment.json", '{"build": {"wpId": 7, "postId" : 8}}'), ("redirects.json", "[]")]
    files = spark.createDataFrame(single, "file string, text string").unionByName(t.agg(locs.alias("text")).select(F.lit("sitemap.xml").alias("file"), "text"))
    overrides = t.filter("page_id % 9 = 0").select("path", (F.col("page_id") % 18 == 0).alias("noindex")).unionByName(spark.createDataFrame([("/search", True)], "path string, noindex boolean"))
    samples = t.filter("page_id % 50 = 0").select(F.concat(F.lit("pages/"), "page_id").alias("id"))
    return inventory, emitted.unionByName(extra).unionByName(stubs).unionByName(files), rules.select("from_path"), overrides, samples


_FILE = "CASE WHEN trim({p}, '/') = '' THEN 'index.html' WHEN trim({p}, '/') = '404' THEN '404.html' ELSE trim({p}, '/') || '/index.html' END"
_TRIM = "CASE WHEN rtrim({p}, '/') = '' THEN '/' ELSE rtrim({p}, '/') END"
_ATTR = r"""(?i)\b(?:src|srcset|href|poster|data-src|data-srcset|data-lazy-src|data-lazy-srcset)=(?:"[^"'']*"|''[^"'']*'')"""
_BUILD = rf"""
bt AS MATERIALIZED (SELECT page_id, {_TRIM.format(p="regexp_extract(key, '^([^?#]*)', 1)")} AS path FROM live WHERE key NOT LIKE '%?%'),
words AS MATERIALIZED (SELECT DISTINCT raw AS path FROM refs WHERE tag = 'a' AND raw LIKE '/%' AND length(raw) % 3 = 0),
inventory AS MATERIALIZED (SELECT path, {_FILE.format(p="path")} AS file, CASE page_id % 10 WHEN 8 THEN 'redirect' WHEN 9 THEN 'data' ELSE 'page' END AS kind FROM bt
  UNION ALL SELECT path, {_FILE.format(p="path")}, CASE WHEN length(path) % 2 = 0 THEN 'page' ELSE 'data' END FROM words),
emitted AS MATERIALIZED (SELECT {_FILE.format(p="bt.path")} AS file, html || '<img src="' || raw || '">' AS text FROM bt JOIN pages USING (page_id) JOIN assets ON doc_id = bt.page_id WHERE bt.page_id % 5 <> 0
  UNION ALL SELECT 'extra/' || page_id || '/index.html', '<html lang="en-GB"><head><meta name="robots" content="noindex"><title>T</title></head><main id="main"><h1>x</h1>This build is coming soon.' FROM bt WHERE page_id % 13 = 0
  UNION ALL SELECT {_FILE.format(p="from_path")}, '<title>moved</title>' FROM rules WHERE ord % 2 = 0
  UNION ALL SELECT * FROM (VALUES ('robots.txt', 'x'), ('deployment.json', 'x'), ('redirects.json', '[]'), ('sitemap.xml', 'x')) t(file, text)),
overrides AS (SELECT path FROM bt WHERE page_id % 18 = 0),
htm AS MATERIALIZED (SELECT file, text FROM emitted WHERE file LIKE '%.html'),
pg AS MATERIALIZED (SELECT path, file, text FROM inventory JOIN htm USING (file) WHERE kind = 'page'),
al AS MATERIALIZED (SELECT path, file, unnest(regexp_extract_all(text, '(?is)<[a-z][a-z0-9-]*\b[^>]*>')) AS tag FROM pg),
hr AS (SELECT path, trim(regexp_replace(a, '(?i)^href\s*=\s*', ''), '"''') AS raw FROM (SELECT path, unnest(regexp_extract_all(tag, '(?i)\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>=`]+)')) AS a FROM al)),
lk AS (SELECT DISTINCT path, regexp_extract(raw, '^([^?#]*)', 1) AS target FROM hr WHERE starts_with(raw, '/') AND NOT starts_with(raw, '//')),
ra AS (SELECT file, lower(regexp_extract(a, '(?i)^([a-z-]+)', 1)) AS name, trim(regexp_replace(a, '(?i)^[a-z-]+=', ''), '"''') AS url FROM (SELECT file, unnest(regexp_extract_all(text, '{_ATTR}')) AS a FROM htm)),
six AS (SELECT 'missing-file' AS code, file AS "at", '' AS detail FROM inventory WHERE file NOT IN (SELECT file FROM emitted)
  UNION SELECT 'unclaimed-file', file, '' FROM htm WHERE file NOT IN (SELECT file FROM inventory)
  UNION SELECT 'missing-stub', f, min(from_path) FROM (SELECT from_path, {_FILE.format(p="from_path")} AS f FROM rules) WHERE f NOT IN (SELECT file FROM emitted) GROUP BY f
  UNION SELECT 'indexed-against-source', path, '' FROM overrides WHERE {_TRIM.format(p="path")} NOT IN ('/search', '/404', '/404.html')
  UNION SELECT 'dead-link', path, target FROM lk WHERE {_TRIM.format(p="target")} NOT IN (SELECT {_TRIM.format(p="path")} FROM inventory) AND NOT regexp_matches({_TRIM.format(p="target")}, '(?i)\.[a-z0-9]{{2,5}}$')
  UNION SELECT 'stale-upload', file, url FROM ra WHERE url LIKE '%/wp-content/uploads/%' AND regexp_replace(lower(regexp_extract(url, '(?i)^(?:https?:)?//([^/?#]*)', 1)), '^www\.', '') IN ('', 'site.example'))
"""


@query("j29_build_audit", o(f', {_BUILD} SELECT code, "at", detail FROM six'))
def j29(spark, d):
    inventory, emitted, redirects, overrides, _ = _build(spark, d)
    return A.path_findings(inventory, emitted, redirects, overrides, SITE)


_OPEN = "{p} NOT IN ('/search', '/404', '/404.html')"
_PAGED = r"regexp_matches({p}, '/page/[0-9]+$')"


@query("g17_build_audit", o(rf""", {_BUILD},
hd AS (SELECT path, text, len(regexp_extract_all(text, '(?i)<h1\b')) AS h1, trim(regexp_extract(text, '(?is)<title\b[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(text, '(?is)<html\b[^>]*\blang="([^"\s>]*)', 1) AS lang,
  regexp_matches(text, '(?i)<main\b[^>]*\bid="main"') AS main, nullif(regexp_extract(regexp_extract(text, '(?is)<head\b.*?</head>', 0), '(?i)<meta name="robots" content="([^"]*)"', 1), '') AS robots FROM pg),
want AS (SELECT *, CASE WHEN {_OPEN.format(p=_TRIM.format(p="path"))} THEN 'index, follow, max-image-preview:large' ELSE 'noindex' END AS w FROM hd),
listed AS (SELECT count(*) AS n FROM inventory WHERE kind = 'page' AND {_OPEN.format(p=_TRIM.format(p="path"))} AND NOT {_PAGED.format(p=_TRIM.format(p="path"))}),
locs AS (SELECT count(*) FILTER (page_id % 3 = 0) AS n FROM bt)
SELECT code, "at", detail FROM six
UNION ALL SELECT 'h1-count', path, h1::VARCHAR FROM want WHERE h1 <> 1
UNION ALL SELECT 'no-title', path, '' FROM want WHERE title = ''
UNION ALL SELECT 'no-lang', path, '' FROM want WHERE NOT regexp_matches(lang, '^[a-z]{{2,3}}(-[A-Z][a-z]{{3}})?(-([A-Z]{{2}}|[0-9]{{3}}))?$')
UNION ALL SELECT 'no-main', path, '' FROM want WHERE NOT main
UNION ALL SELECT 'wrong-robots', path, coalesce(robots, '') FROM want WHERE robots IS DISTINCT FROM w
UNION ALL SELECT DISTINCT 'insecure-media', path, url FROM pg JOIN ra USING (file) WHERE name IN ('src', 'data-src') AND starts_with(url, 'http://')
UNION ALL SELECT 'wrong-robots-txt', 'robots.txt', ''
UNION ALL SELECT 'sitemap-count', 'sitemap.xml', locs.n || ' of ' || listed.n FROM locs, listed WHERE locs.n <> listed.n
UNION ALL SELECT * FROM (VALUES ('source-id-served', 'deployment.json', 'wpId'), ('source-id-served', 'deployment.json', 'postId'), ('missing-artifact', '_redirects', '')) t(code, "at", detail)
UNION ALL SELECT 'sample-content', 'pages/' || page_id, '' FROM bt WHERE page_id % 50 = 0"""))
def g17(spark, d):
    return A.audit(*_build(spark, d), SITE)


ORIGIN = "https://site.example"
MAPS = 5


def _site(spark, d):
    """Stored responses: every page under its key, hub pages under the first link of a menu, a front page, robots.txt, a sitemap index, a sitemap
    a fifth of the pages (the last refuses), and one that is gone."""
    t, html = B.live(spark, d).select("page_id", "key"), B.pages(spark, d).select("page_id", "html")
    menu = html.select("page_id", "html", F.regexp_extract("html", '<a href="(/[^"]*)"', 1).alias("menu"))
    hubs = menu.groupBy("menu").agg(F.min_by("html", "page_id").alias("body")).select(F.concat(F.lit(ORIGIN), "menu", F.lit("/")).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "body")
    pages = t.join(html, "page_id").select(F.concat(F.lit(ORIGIN), "key").alias("url"), F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    front = html.filter("page_id = 0").select(F.lit(f"{ORIGIN}/").alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    locs = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "key"))), lambda x: F.concat(F.lit(f"<loc>{ORIGIN}"), x["key"], F.lit("</loc>")))
    part = F.col("page_id") % MAPS
    maps = t.groupBy(part.alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(locs, ""), F.lit("</urlset>")).alias("body"))
    maps = maps.select(F.concat(F.lit(f"{ORIGIN}/map"), "k", F.lit(".xml")).alias("url"), F.when(F.col("k") == MAPS - 1, 503).otherwise(200).alias("status"), F.lit("text/xml").alias("content_type"), "body")
    index = "<sitemapindex>" + "".join(f"<loc>{ORIGIN}/map{k}.xml</loc>" for k in range(MAPS)) + "</sitemapindex>"
    fixed = [(f"{ORIGIN}/robots.txt", 200, "text/plain", f"Sitemap: {ORIGIN}/index.xml\nsitemap: {ORIGIN}/gone.xml"), (f"{ORIGIN}/index.xml", 200, "text/xml", index), (f"{ORIGIN}/gone.xml", 404, "text/html", "<p>gone</p>")]
    whole = pages.unionByName(hubs).unionByName(front).unionByName(maps).unionByName(spark.createDataFrame(fixed, "url string, status int, content_type string, body string"))
    return whole.withColumn("location", F.lit(None).cast("string"))


_REF = "CASE WHEN regexp_matches(raw, '\\.[A-Za-z0-9]{1,5}$') OR raw LIKE '%/' THEN raw ELSE raw || '/' END"
_SKIP = r"""CASE WHEN {k} LIKE '%?_%' THEN 'query-variant' WHEN regexp_matches({k}, '(?i)\.(png|jpe?g|webp|avif|gif|svg|css|js|mjs|woff2?|ico|mp4|webm|pdf|zip|docx?|xlsx?)$') THEN 'media-asset' WHEN {k} <> '/feed/' AND {k} LIKE '%/feed/' THEN 'per-page-feed'
  WHEN string_split({k}, '/')[2] IN ('de', 'fr') AND {k} NOT IN ('/de/', '/fr/') THEN 'translated-deep-page' END"""


def _crawled(most: int, waves: int = 2) -> str:
    """The crawl's waves as common table expressions: r0, r1, ... and records."""
    sql = rf""", menus AS (SELECT regexp_extract(html, '<a href="(/[^"]*)"', 1) AS menu, min(page_id) AS page_id FROM pages GROUP BY 1),
site_ AS MATERIALIZED (SELECT key, page_id, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status FROM live UNION ALL SELECT menu || '/', page_id, 200 FROM menus UNION ALL SELECT '/', 0, 200),
al_ AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>') AS l FROM pages)),
out_ AS MATERIALIZED (SELECT page_id, i, {_REF} AS key FROM (SELECT page_id, i, regexp_extract(regexp_extract(tag, 'href="([^"]*)"', 1), '^([^#]*)', 1) AS raw FROM al_) WHERE starts_with(raw, '/')),
w0_ AS (SELECT key, page_id % {MAPS} AS a, page_id AS b, 'sitemap:/map' || page_id % {MAPS} || '.xml' AS source FROM live WHERE page_id % {MAPS} < {MAPS - 1} UNION ALL SELECT '/', 99, 0, 'seed'),
n0 AS (SELECT key, arg_min(a, (a, b)) AS a, min((a, b)) AS o FROM w0_ GROUP BY key), req0 AS (SELECT {3 + MAPS}::BIGINT AS n), seen0 AS (SELECT NULL::VARCHAR AS key WHERE false)"""
    for w in range(waves + 1):
        if w:
            sql += f""", l{w} AS MATERIALIZED (SELECT o.key, r.position AS a, o.i AS b, 'link:' || r.key AS source FROM r{w - 1} r JOIN site_ s ON s.key = r.key JOIN out_ o ON o.page_id = s.page_id WHERE r.fetched),
req{w} AS (SELECT (SELECT n FROM req{w - 1}) + count(*) FILTER (fetched) AS n FROM r{w - 1}), seen{w} AS MATERIALIZED (SELECT key FROM seen{w - 1} UNION ALL SELECT key FROM r{w - 1}), n{w} AS (SELECT key, min((a, b)) AS o FROM l{w} WHERE key NOT IN (SELECT key FROM seen{w}) GROUP BY key)"""
        sql += f""", k{w} AS (SELECT key, o, {_SKIP.format(k="key")} AS skip FROM n{w}),
b{w} AS (SELECT key, skip, row_number() OVER (ORDER BY o, key) - 1 AS rank, coalesce(sum((skip IS NULL)::INT) OVER (ORDER BY o, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT n FROM req{w}) < {most} AS alive FROM k{w}),
r{w} AS MATERIALIZED (SELECT b.key, {w} AS wave, rank + (SELECT count(*) FROM seen{w}) AS position, alive AND skip IS NULL AS fetched, CASE WHEN alive AND skip IS NULL THEN coalesce(s.status, 0) END AS status, CASE WHEN alive THEN skip END AS skipped FROM b{w} b LEFT JOIN site_ s ON s.key = b.key)"""
    ways = " UNION ALL ".join(f"SELECT key, source FROM l{w}" for w in range(1, waves + 1))
    rows = " UNION ALL ".join(f"SELECT * FROM r{w}" for w in range(waves + 1))
    return sql + f""", ways AS (SELECT DISTINCT key, source FROM w0_ UNION SELECT DISTINCT key, source FROM ({ways})), records AS (SELECT r.*, n_sources FROM ({rows}) r JOIN (SELECT key, count(*) AS n_sources FROM ways GROUP BY key) USING (key))"""


_RECORDS = "SELECT key, wave, position::BIGINT AS position, fetched, status, skipped, n_sources FROM records"


@query("s12_crawl", o(_crawled(10**9) + _RECORDS))
def s12(spark, d):
    """The whole site: no budget ends it."""
    return W.crawl(_site(spark, d), ORIGIN, B.LINKS, 2, 10**9).records.select("key", "wave", "position", "fetched", "status", "skipped", "n_sources")


@query("s12_bounded_crawl", o(_crawled(100) + _RECORDS))
def s12_bounded(spark, d):
    """A hundred requests: the budget is the feature."""
    return W.crawl(_site(spark, d), ORIGIN, B.LINKS, 2, 100).records.select("key", "wave", "position", "fetched", "status", "skipped", "n_sources")


@query("s12_crawl_sources", o(_crawled(10**9) + "SELECT key, source FROM ways"))
def s12_sources(spark, d):
    return W.crawl(_site(spark, d), ORIGIN, B.LINKS, 2, 10**9).sources.select("key", "source")


@query("h07_sitemap_index", o(f", docs AS (SELECT '{ORIGIN}/index.xml' AS url, 0 AS round, 'index' AS state UNION ALL SELECT '{ORIGIN}/gone.xml', 0, 'refused-status' UNION ALL SELECT DISTINCT '{ORIGIN}/map' || page_id % {MAPS} || '.xml', 1, CASE WHEN page_id % {MAPS} = {MAPS - 1} THEN 'refused-status' ELSE 'read' END FROM live), n AS (SELECT '{ORIGIN}/map' || page_id % {MAPS} || '.xml' AS url, count(*) AS n FROM live WHERE page_id % {MAPS} < {MAPS - 1} GROUP BY 1) SELECT url, round, state, coalesce(n, 0)::BIGINT AS locations FROM docs LEFT JOIN n USING (url)"))
def h07(spark, d):
    """Sitemaps that an index names: what was attempted, what was read, and how many locations it holds."""
    read = W.cut(W.responses(_site(spark, d), ORIGIN))
    seeds = read.filter(F.col("url") == f"{ORIGIN}/robots.txt").select(F.posexplode("robots").alias("c", "url")).select("url", F.lit(0).cast("long").alias("b"), F.col("c").cast("long").alias("c"))
    attempted, found, _ = W.read_sitemaps(read, seeds, 10**9)
    n = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    t = attempted.withColumn("source", F.concat(F.lit("sitemap:"), F.regexp_extract("url", "^[a-z]+://[^/]*(.*)", 1)))
    return t.join(n, "source", "left").select("url", "round", "state", F.coalesce("n", F.lit(0)).alias("locations"))


@query("h06_crawl_waves", o(_crawled(10**9) + """, e AS (SELECT DISTINCT s.key AS source, o.key AS target FROM site_ s JOIN out_ o USING (page_id)), v0 AS (SELECT '/' AS url), v1 AS (SELECT DISTINCT target AS url FROM e JOIN v0 ON source = url WHERE target <> '/'), v2 AS (SELECT DISTINCT target AS url FROM e JOIN v1 ON source = url WHERE target <> '/' AND target NOT IN (SELECT url FROM v1)),
v3 AS (SELECT DISTINCT target AS url FROM e JOIN v2 ON source = url WHERE target <> '/' AND target NOT IN (SELECT url FROM v1) AND target NOT IN (SELECT url FROM v2)) SELECT url, 0 AS wave FROM v0 UNION ALL SELECT url, 1 FROM v1 UNION ALL SELECT url, 2 FROM v2 UNION ALL SELECT url, 3 FROM v3"""))
def h06(spark, d):
    """What three waves of the pages' own links reach from the front page."""
    site = _site(spark, d).filter("content_type = 'text/html'")
    key = U.comparison_key(F.col("url"), F.lit(ORIGIN))
    refs = site.select(key.alias("source"), F.explode(H.link_references(F.col("body"))).alias("r")).filter("r.tag = 'a' and r.raw like '/%'")
    links = refs.select("source", U.comparison_key(U.resolve(F.col("r.raw"), F.lit(ORIGIN)), F.lit(ORIGIN)).alias("target")).distinct()
    return Y.crawl_waves(links, spark.createDataFrame([("/",)], "url string"), 3)


def _digests(spark, d):
    """routes (route, template, file), recorded, built: a line a link of a page, with a box from its place and length that the build moves by up to two."""
    t = B.live(spark, d).join(B.pages(spark, d).select("page_id", "html"), "page_id").withColumn("file", F.concat("page_id", F.lit(".txt")))
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    text = lambda move: F.array_join(F.transform(hrefs, lambda h, i: F.concat(F.lit("a"), i.cast("string"), F.lit(" | "), F.length(h).cast("string"), F.lit(" "), (i * 10 + move).cast("string"), F.lit(" | color | "), h)), "\n")
    routes = t.select(F.col("key").alias("route"), F.when(F.col("family") != "entry", F.col("family")).alias("template"), "file")
    recorded = t.filter("page_id % 7 <> 0").select("file", text(F.lit(0)).alias("text"))
    return routes, recorded, t.filter("page_id % 9 <> 0").select("file", text((F.col("page_id") % 3).cast("int")).alias("text"))


@query("g13_render_digest", o(r""", ranked AS (SELECT page_id, key, family, row_number() OVER (PARTITION BY family ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM live),
kept AS (SELECT page_id FROM ranked WHERE family = 'entry' OR n <= 6 OR list_contains(list_transform(range(0, 6), lambda j: floor(j * (n - 1) / 5.0 + 0.5)::BIGINT), i)),
hr AS (SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n FROM pages JOIN kept USING (page_id))
SELECT page_id || '.txt' AS file, 'changed' AS kind, n::BIGINT AS removed, n::BIGINT AS added FROM hr WHERE page_id % 7 <> 0 AND page_id % 9 <> 0 AND page_id % 3 = 2 AND n > 0
UNION ALL SELECT page_id || '.txt', 'unrecorded', 0, 0 FROM hr WHERE page_id % 7 = 0 AND page_id % 9 <> 0 UNION ALL SELECT page_id || '.txt', 'vanished', 0, 0 FROM hr WHERE page_id % 7 <> 0 AND page_id % 9 = 0"""))
def g13(spark, d):
    return G.gate(*_digests(spark, d))
