"""Gates over both sides of a migration, and operators that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import routes as N
from ..functions import url as U
from ..operators import inventory as V
from ..operators import ordering as O
from ..sources import sinks as K
from . import bridge as B
from .q_join import _DIFF, _INT, _integrity, diffed
from .q_scalar import _ASSET
from .registry import query

o = B.oracle

_SIDES = r""", side AS (SELECT (doc_id // 2)::VARCHAR AS route, doc_id % 2 AS s, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) AS asked, lower(body) AS said FROM posts),
rul AS (SELECT * FROM (VALUES ('3', 'the'), (NULL, 'the'), (NULL, 'tion'), (NULL, 'zzzz'), ('nowhere', 'der')) t(scope, key)),
pair AS (SELECT a.route, a.asked AS a1, a.said AS s1, b.asked AS a2, b.said AS s2 FROM side a JOIN side b ON a.route = b.route AND a.s = 0 AND b.s = 1),
ask AS (SELECT route, 'live' AS side, unnest(a1) AS key, s2 AS other FROM pair UNION ALL SELECT route, 'ours', unnest(a2), s1 FROM pair),
found AS (SELECT ask.route, side, ask.key, contains(other, ask.key) AND regexp_matches(other, '(^|[^\p{L}\p{N}\p{M}‍‌])' || ask.key || '($|[^\p{L}\p{N}\p{M}‍‌])') AS hit, CASE WHEN r1.key IS NOT NULL THEN r1.scope || ':' || r1.key WHEN r2.key IS NOT NULL THEN ':' || r2.key END AS used
  FROM ask LEFT JOIN rul r1 ON r1.scope = ask.route AND r1.key = ask.key LEFT JOIN rul r2 ON r2.scope IS NULL AND r2.key = ask.key),
acc AS (SELECT *, CASE WHEN hit AND used IS NOT NULL THEN 'contradicted' WHEN hit THEN 'matched' WHEN used IS NOT NULL THEN 'ruled' WHEN side = 'live' THEN 'unpainted' ELSE 'invented' END AS state FROM found)"""


def _accounts(spark, d):
    p = B.posts(spark, d)
    asked = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]{3,}"), 0))
    side = p.select(F.floor(F.col("doc_id") / 2).cast("string").alias("route"), (F.col("doc_id") % 2).alias("s"), asked.alias("asked"), F.lower("body").alias("said"))
    rulings = spark.createDataFrame([("3", "the"), (None, "the"), (None, "tion"), (None, "zzzz"), ("nowhere", "der")], "scope string, key string")
    return V.account(side.filter("s = 0"), side.filter("s = 1"), rulings), rulings


@query("g07_reconcile", o(_SIDES + """ SELECT state AS kind, route, key FROM acc WHERE state IN ('unpainted', 'invented') UNION ALL SELECT DISTINCT state, route, key FROM acc WHERE state = 'contradicted'
UNION ALL SELECT 'stale', NULL, key FROM rul WHERE coalesce(scope, '') || ':' || key NOT IN (SELECT used FROM acc WHERE used IS NOT NULL)"""))
def g07(spark, d):
    return V.reconcile_problems(*_accounts(spark, d))


@query("g07_reconciled_routes", o(_SIDES + """ SELECT route, count(*) FILTER (side = 'live') AS live_asked, count(*) FILTER (side = 'ours') AS ours_asked, count(*) FILTER (side = 'live' AND hit) AS matched,
count(*) FILTER (side = 'live' AND state = 'ruled') AS ruled, count(*) FILTER (side = 'ours' AND state = 'ruled') AS ours_ruled FROM acc GROUP BY route"""))
def g07b(spark, d):
    return V.reconcile_routes(_accounts(spark, d)[0])


_ORIGIN = """, own AS (SELECT CASE WHEN doc_id % 97 = 1 THEN 'posts/shared@en' ELSE 'posts/' || slug || '@' || locale END AS id, CASE WHEN length(title) % 5 > 0 THEN ['wordpress', 'authored', 'derived', 'sample'][length(title) % 5] END AS origin,
length(body) % 3 = 0 AS has_source, CASE WHEN length(body) % 4 = 0 THEN '' WHEN length(body) % 4 = 1 THEN author END AS derived_by, 'wp:' || md5(title) AS claim FROM posts),
prov AS (SELECT 'IDENTITY_CONTESTED' AS code, id FROM own GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'PROVENANCE_MISSING', id FROM (SELECT id, unnest(range(CASE WHEN origin IS NULL THEN 1 ELSE has_source::INT + (origin = 'derived' AND coalesce(derived_by, '') = '')::INT + (origin <> 'derived' AND derived_by IS NOT NULL)::INT END)) FROM own)
UNION ALL SELECT 'PROVENANCE_CONTESTED', claim FROM own WHERE claim IS NOT NULL GROUP BY claim HAVING count(*) > 1)"""


def _provenance(spark, d):
    p = B.posts(spark, d)
    i, n, m = F.col("doc_id"), F.length("title") % 5, F.length("body")
    own = p.select(
        F.when(i % 97 == 1, "posts/shared@en").otherwise(U.entry_id(F.lit("posts"), F.col("slug"), F.col("locale"))).alias("id"), F.when(n == 1, "wordpress").when(n == 2, "authored").when(n == 3, "derived").when(n == 4, "sample").alias("origin"),
        (m % 3 == 0).alias("has_source"), F.when(m % 4 == 0, "").when(m % 4 == 1, F.col("author")).alias("derived_by"), F.concat(F.lit("wp:"), F.md5("title")).alias("claim"),
    )
    return V.provenance_findings(own, own.filter("claim is not null").select(F.col("claim").alias("key"), F.col("id").alias("by")))


@query("j02_provenance", o(_ORIGIN + " SELECT * FROM prov"))
def j02b(spark, d):
    return _provenance(spark, d)


@query("g08_content_integrity", o(_INT + _ORIGIN + """, ci AS (SELECT 'SOURCE_ONLY' AS code, id FROM intended WHERE id NOT IN (SELECT id FROM firsts) AND id NOT IN (SELECT id FROM excl)
UNION ALL SELECT 'FILE_MISSING', id FROM firsts WHERE r.file NOT IN (SELECT file FROM files) UNION ALL SELECT 'OUTPUT_ONLY', id FROM firsts WHERE NOT starts_with(id, '@') AND id NOT IN (SELECT id FROM intended)
UNION ALL SELECT 'UNUSED_EXCLUSION', id FROM excl WHERE id IN (SELECT id FROM firsts) UNION ALL SELECT 'IDENTITY_CONTESTED', id FROM firsts WHERE paths > 1 AND NOT starts_with(id, '@'))
SELECT code, count(*)::BIGINT AS n FROM (SELECT * FROM ci UNION ALL SELECT * FROM prov) GROUP BY code"""))
def g08(spark, d):
    every = V.content_integrity(*_integrity(spark, d)).unionByName(_provenance(spark, d))
    return every.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("f22_identity_of", o("""SELECT page_id, kind, CASE kind WHEN 'page' THEN 'pages/' || s || '@en' WHEN 'post' THEN 'posts/' || s || '@en' WHEN 'custom' THEN 'news/' || s || '@en' WHEN 'custom-archive' THEN '@archive/news' WHEN 'taxonomy-archive' THEN 'news/' || s
WHEN 'posts' THEN CASE WHEN page_id % 2 = 0 THEN '@posts-index' ELSE 'pages/' || s || '@en' END WHEN 'category' THEN 'categories/' || s WHEN 'tag' THEN 'tags/' || s WHEN 'author' THEN 'authors/' || s END AS id
FROM (SELECT page_id, path AS s, unnest(['page', 'post', 'custom', 'custom-archive', 'taxonomy-archive', 'posts', 'category', 'tag', 'author']) AS kind FROM live)"""))
def f22(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("page", "post", "custom", "custom-archive", "taxonomy-archive", "posts", "category", "tag", "author")]))
    t = B.live(spark, d).select("page_id", U.path_part(F.col("key")).alias("s"), kinds.alias("kind"))
    listed = F.col("kind").isin("posts", "category", "tag", "author")
    slug = F.when((F.col("kind") != "posts") | (F.col("page_id") % 2 != 0), F.col("s"))
    return t.select("page_id", "kind", N.identity_of(F.when(listed, "archive").otherwise(F.col("kind")), F.col("kind"), F.lit("news"), slug, F.lit("en")).alias("id"))


@query("f04_custom_type_path", o("""SELECT doc_id, '/news/' || year(published) || '/' || lpad(month(published)::VARCHAR, 2, '0') || '/' || lpad(day(published)::VARCHAR, 2, '0') || '/' || slug || '/' AS path, '/news/' || author || '/' AS archive FROM posts"""))
def f04(spark, d):
    p = B.posts(spark, d)
    archive = N.custom_type_archive_path(F.concat(F.lit("news//"), F.col("author")))
    return p.select("doc_id", N.custom_type_path("/news/%year%/%monthnum%/%day%/%postname%/", F.col("slug"), F.col("published").cast("string")).alias("path"), archive.alias("archive"))


@query("x02_asset_references", o(_ASSET + " SELECT doc_id, raw AS url, 'src' AS kind, classification FROM asset_ids UNION ALL SELECT doc_id, raw, 'href', classification FROM asset_ids WHERE classification IN ('SUPPORTED', 'CONFIGURED')"))
def x02(spark, d):
    html = F.concat(F.lit("<img src='"), F.col("raw"), F.lit("'><a href=\""), F.col("raw"), F.lit("\">x</a>"))
    each = F.explode(H.asset_references(html, B.MEDIA)).alias("r")
    return B.assets(spark, d).select("doc_id", each).select("doc_id", "r.url", "r.kind", "r.asset.classification")


_FORMS = ", forms AS (SELECT slug, name, CASE WHEN starts_with(slug, 'r') THEN 'unassigned' ELSE 'support' END AS owner, 'WPK_FORM_ENDPOINT_' || replace(upper(replace(name, ' ', '-')), '-', '_') AS variable, CASE WHEN length(name) % 3 = 0 THEN ' https://forms.example/' || slug || ' ' WHEN length(name) % 3 = 1 THEN 'http://' || slug END AS setting FROM terms), told AS (SELECT *, CASE WHEN setting IS NULL THEN 'undecided' WHEN regexp_matches(trim(setting), '^https://[^\\s\"''<>]+$') THEN 'http-post' ELSE 'refused' END AS transport FROM forms)"


def _forms(spark, d):
    n = F.length("name") % 3
    setting = F.when(n == 0, F.concat(F.lit(" https://forms.example/"), F.col("slug"), F.lit(" "))).when(n == 1, F.concat(F.lit("http://"), F.col("slug")))
    t = B.terms(spark, d).select("slug", F.when(F.col("slug").startswith("r"), "unassigned").otherwise("support").alias("owner"), N.endpoint_variable(F.replace(F.col("name"), F.lit(" "), F.lit("-"))).alias("variable"), setting.alias("setting"))
    return t.withColumn("transport", N.transport_of(F.col("setting")))


@query("f54_form_transports", o(_FORMS + " SELECT slug, variable, transport FROM told"))
def f54(spark, d):
    return _forms(spark, d).select("slug", "variable", "transport")


@query("p22_form_routes", o(_FORMS + " SELECT slug, 'undeliverable' AS code FROM told WHERE transport = 'undecided' UNION ALL SELECT slug, 'unassigned' FROM told WHERE owner = 'unassigned'"))
def p22(spark, d):
    t = _forms(spark, d)
    codes = F.array_compact(F.array(F.when(F.col("transport") == "undecided", "undeliverable"), F.when(F.col("owner") == "unassigned", "unassigned")))
    return t.select("slug", F.explode(codes).alias("code"))


@query("t06_report_lines", o(_DIFF + """, rk AS (SELECT classification, key, row_number() OVER (PARTITION BY classification ORDER BY key) AS pos FROM diff)
SELECT classification, pos::INT AS pos, key FROM rk WHERE pos <= 20 UNION ALL SELECT classification, 21, '… and ' || (count(*) - 20) || ' more' FROM diff GROUP BY 1 HAVING count(*) > 20"""))
def t06(spark, d):
    return O.report_lines(diffed(spark, d), "classification", "key", 20)


@query("k11_digest_text", o("SELECT page_id, string_agg(raw, chr(10) ORDER BY raw) || chr(10) AS body FROM refs GROUP BY page_id"))
def k11(spark, d):
    return B.refs(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list("raw")).alias("x")).select("page_id", K.digest_text(F.col("x")).alias("body"))
