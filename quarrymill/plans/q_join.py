"""Joins, anti-joins and two-sided comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import identity as I
from ..operators import inventory as V
from ..operators import transform as X
from ..operators import discovery as S
from . import bridge as B
from .q_scalar import _ASSET, _PAL
from .registry import query

o = B.oracle

_TRIM = "CASE WHEN rtrim({x}, '/') = '' THEN '/' ELSE rtrim({x}, '/') END"
_DIFF = f""", pub AS (SELECT key FROM local WHERE NOT redirect),
goal AS (SELECT from_path, to_path, NOT starts_with(to_path, '/') OR to_path IN (SELECT key FROM pub) OR ({_TRIM.format(x="regexp_extract(to_path, '^([^?#]*)', 1)")}) || '/' IN (SELECT key FROM pub) AS there FROM rules),
d1 AS (SELECT l.*, {_TRIM.format(x="path")} AS tp FROM live l),
d2 AS (SELECT d1.key, d1.family, lo.redirect AS stub, g.to_path, g.there, starts_with(tp, '/de') OR starts_with(tp, '/fr') AS splat FROM d1 LEFT JOIN local lo ON lo.key = d1.key LEFT JOIN goal g ON g.from_path = d1.tp),
diff AS (SELECT key, family, CASE WHEN stub = false THEN 'MATCH' WHEN to_path IS NOT NULL THEN CASE WHEN there THEN 'REDIRECT' ELSE 'GAP' END WHEN splat THEN 'REDIRECT'
    WHEN family IN ('media') THEN 'RETIRED' WHEN family IN ('wp-internal', 'media', 'feed', 'sitemap', 'query-variant', 'search') THEN 'INFRASTRUCTURE' ELSE 'GAP' END AS classification,
    CASE WHEN stub = false THEN NULL ELSE to_path END AS redirect_target FROM d2
  UNION ALL SELECT key, family, 'LOCAL_ONLY', NULL FROM local_family WHERE NOT redirect AND key NOT IN (SELECT key FROM live))"""


def diffed(spark, d):
    return V.diff(B.live(spark, d), B.local(spark, d), B.rules(spark, d), B.SPLATS, B.RETIRED, B.LINKS)


@query("j01_inventory_diff", o(_DIFF + " SELECT key, family, classification, redirect_target FROM diff"))
def j01(spark, d):
    return diffed(spark, d)


_INT = """, intended AS (SELECT 'posts/' || slug || '@' || locale AS id, doc_id FROM posts), excl AS (SELECT id FROM intended WHERE doc_id % 10 = 0 OR doc_id % 23 = 0),
emitted AS (SELECT id, '/' || doc_id || '/' AS path, doc_id || '/index.html' AS file FROM intended WHERE doc_id % 10 <> 0 AND doc_id % 9 <> 0 UNION ALL SELECT id, '/alias/' || doc_id || '/', 'alias/' || doc_id || '.html' FROM intended WHERE doc_id % 31 = 1
  UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN '@home' ELSE 'ghost/' || doc_id END, '/ghost/' || doc_id || '/', 'ghost.html' FROM intended WHERE doc_id % 50 < 2),
files AS (SELECT DISTINCT file FROM emitted WHERE file NOT LIKE '%7/index.html'),
firsts AS (SELECT id, min({'path': path, 'file': file}) AS r, count(DISTINCT path) AS paths FROM emitted GROUP BY id)"""


def _integrity(spark, d):
    p = B.posts(spark, d)
    intended = p.select(U.entry_id(F.lit("posts"), F.col("slug"), F.col("locale")).alias("id"), "doc_id")
    i = F.col("doc_id").cast("string")
    excl = intended.filter("doc_id % 10 = 0 or doc_id % 23 = 0").select("id")
    own = intended.filter("doc_id % 10 <> 0 and doc_id % 9 <> 0").select("id", F.concat(F.lit("/"), i, F.lit("/")).alias("path"), F.concat(i, F.lit("/index.html")).alias("file"))
    alias = intended.filter("doc_id % 31 = 1").select("id", F.concat(F.lit("/alias/"), i, F.lit("/")).alias("path"), F.concat(F.lit("alias/"), i, F.lit(".html")).alias("file"))
    ghost = intended.filter("doc_id % 50 < 2").select(F.when(F.col("doc_id") % 2 == 0, "@home").otherwise(F.concat(F.lit("ghost/"), i)).alias("id"), F.concat(F.lit("/ghost/"), i, F.lit("/")).alias("path"), F.lit("ghost.html").alias("file"))
    emitted = own.unionByName(alias).unionByName(ghost)
    return intended, emitted, emitted.filter(~F.col("file").endswith("7/index.html")).select("file").distinct(), excl


@query("j02_content_integrity", o(_INT + """ SELECT 'SOURCE_ONLY' AS code, id FROM intended WHERE id NOT IN (SELECT id FROM firsts) AND id NOT IN (SELECT id FROM excl)
UNION ALL SELECT 'FILE_MISSING', id FROM firsts WHERE r.file NOT IN (SELECT file FROM files) UNION ALL SELECT 'OUTPUT_ONLY', id FROM firsts WHERE NOT starts_with(id, '@') AND id NOT IN (SELECT id FROM intended)
UNION ALL SELECT 'UNUSED_EXCLUSION', id FROM excl WHERE id IN (SELECT id FROM firsts) UNION ALL SELECT 'IDENTITY_CONTESTED', id FROM firsts WHERE paths > 1 AND NOT starts_with(id, '@')"""))
def j02(spark, d):
    return V.content_integrity(*_integrity(spark, d))


@query("j03_reconcile", o(r""", keys AS (SELECT w AS key FROM (VALUES ('the'), ('le'), ('tion'), ('thst'), ('der')) t(w)), rul AS (SELECT * FROM (VALUES ('en', 'tion', 'kept'), (NULL, 'le', 'reworded')) t(scope, key, ruling)),
asked AS (SELECT doc_id::VARCHAR AS route, locale, key, lower(body) AS said FROM posts CROSS JOIN keys),
hits AS (SELECT route, a.key, regexp_matches(said, '(^|[^\p{L}\p{N}\p{M}])' || a.key || '($|[^\p{L}\p{N}\p{M}])') AS hit, coalesce(r1.ruling, r2.ruling) AS ruling FROM asked a LEFT JOIN rul r1 ON r1.scope = a.route AND r1.key = a.key LEFT JOIN rul r2 ON r2.scope IS NULL AND r2.key = a.key)
SELECT route, key, CASE WHEN hit AND ruling IS NOT NULL THEN 'contradicted' WHEN hit THEN 'matched' WHEN ruling IS NOT NULL THEN 'ruled' ELSE 'unpainted' END AS verdict FROM hits"""))
def j03(spark, d):
    p = B.posts(spark, d).select(F.col("doc_id").cast("string").alias("route"), F.lower("body").alias("said"))
    asked = p.select("route", F.explode(F.array(*[F.lit(w) for w in ("the", "le", "tion", "thst", "der")])).alias("key"))
    rul = spark.createDataFrame([("en", "tion", "kept"), (None, "le", "reworded")], "scope string, key string, ruling string")
    return V.reconcile(asked, p, rul)


@query("j04_taxonomy_references", o("""SELECT doc_id, 'author-unknown' AS code, author AS value FROM posts WHERE author IN ('src1', 'src2') UNION ALL SELECT doc_id, 'category-unregistered', c FROM (SELECT doc_id, unnest(categories) AS c FROM posts) WHERE c = 'c3'
UNION ALL SELECT doc_id, 'tag-unregistered', t FROM (SELECT doc_id, unnest(tags) AS t FROM posts) WHERE t IN ('t5', 't16')"""))
def j04(spark, d):
    p = B.posts(spark, d)
    authors = p.select("author").distinct().filter(~F.col("author").isin("src1", "src2"))
    cats = spark.createDataFrame([(f"c{i}",) for i in range(7) if i != 3], "value string")
    tags = spark.createDataFrame([(f"t{i}",) for i in range(17) if i not in (5, 16)], "value string")
    a = I.missing(p, authors, "author").select("doc_id", F.lit("author-unknown").alias("code"), F.col("author").alias("value"))
    c = I.missing(p.select("doc_id", F.explode("categories").alias("value")), F.broadcast(cats), "value").select("doc_id", F.lit("category-unregistered").alias("code"), "value")
    t = I.missing(p.select("doc_id", F.explode("tags").alias("value")), F.broadcast(tags), "value").select("doc_id", F.lit("tag-unregistered").alias("code"), "value")
    return a.unionByName(c).unionByName(t)


_AUTH = "authors AS (SELECT DISTINCT author AS slug, CASE WHEN author LIKE '%1' THEN NULL ELSE 'nice-' || author END AS nicename FROM posts)"


@query("j05_author_lookup", o(f", {_AUTH} SELECT doc_id, '/author/' || coalesce(nicename, author) || '/' AS path FROM posts LEFT JOIN authors ON authors.slug = author"))
def j05(spark, d):
    p = B.posts(spark, d)
    a = p.select(F.col("author")).distinct().withColumn("nicename", F.when(~F.col("author").endswith("1"), F.concat(F.lit("nice-"), F.col("author"))))
    return p.join(a, "author", "left").select("doc_id", U.expand(B.LINKS.author, nicename=F.coalesce("nicename", "author")).alias("path"))


@query("j06_term_membership", o("SELECT t AS term, count(*)::BIGINT AS entries FROM (SELECT unnest(tags) AS t FROM posts) WHERE t <> 't0' GROUP BY t"))
def j06(spark, d):
    reg = spark.createDataFrame([(f"t{i}",) for i in range(1, 17)], "term string")
    return B.posts(spark, d).select(F.explode("tags").alias("term")).join(F.broadcast(reg), "term").groupBy("term").agg(F.count(F.lit(1)).alias("entries"))


@query("j07_resolve_ids", o("SELECT o_orderkey, array_to_string(list(coalesce('p' || CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END, '') ORDER BY l_linenumber, l_partkey) FILTER (l_partkey % 5 <> 0), ',') AS slugs, count(*) FILTER (l_partkey % 5 = 0)::BIGINT AS lost FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"))
def j07(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    rows = rows.join(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id")
    reg = B.table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("slug"))
    t = X.resolve(rows, "ids", reg, "slugs")
    return t.select(F.col("id").alias("o_orderkey"), F.when(F.size("slugs") > 0, F.array_join("slugs", ",")).alias("slugs"), F.col("slugs_lost").alias("lost"))


@query("j08_related_content", o(""", fl AS (SELECT doc_id AS id, locale, unnest(list_concat(list_transform(categories, lambda c: {'f': 'c:' || c, 'w': 2}), list_transform(tags, lambda t: {'f': 't:' || t, 'w': 1}))) AS x FROM posts),
lf AS (SELECT id, locale, x.f AS f, sum(x.w) AS w FROM fl GROUP BY ALL), rf AS (SELECT DISTINCT fl.id AS other, fl.locale, x.f AS f, published FROM fl JOIN posts ON doc_id = fl.id),
sc AS (SELECT l.id, r.other, r.published, sum(l.w)::BIGINT AS score FROM lf l JOIN rf r ON r.locale = l.locale AND r.f = l.f AND r.other <> l.id GROUP BY ALL),
rk AS (SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, published DESC, other) AS rank FROM sc) SELECT id, other, score, rank FROM rk WHERE rank <= 3"""))
def j08(spark, d):
    return S.related(B.posts(spark, d).select(F.col("doc_id").alias("id"), "locale", F.col("published").alias("date"), "categories", "tags"))


@query("j09_override_lookup", o(", ov AS (SELECT path, arg_min(page_id, page_id) AS first FROM live GROUP BY path) SELECT page_id, first FROM live JOIN ov USING (path)"))
def j09(spark, d):
    t = B.live(spark, d).withColumn("path", U.path_part(F.col("key")))
    first, _ = I.first_wins(t.select("path", F.col("page_id").alias("first")), "path", "first")
    return t.join(first, "path").select("page_id", "first")


_FOUND = "promised AS (SELECT page_id || '/index.html' AS file FROM live WHERE page_id % 4 <> 0), found AS (SELECT page_id || CASE WHEN page_id % 9 = 0 THEN '.xml' ELSE '/index.html' END AS file, CASE WHEN page_id % 6 = 0 THEN 0 ELSE 10 END AS bytes FROM live WHERE page_id % 5 <> 0)"


def _promised(spark, d):
    t = B.live(spark, d)
    i = F.col("page_id").cast("string")
    promised = t.filter("page_id % 4 <> 0").select(F.concat(i, F.lit("/index.html")).alias("file"))
    found = t.filter("page_id % 5 <> 0").select(F.concat(i, F.when(F.col("page_id") % 9 == 0, ".xml").otherwise("/index.html")).alias("file"), F.when(F.col("page_id") % 6 == 0, 0).otherwise(10).alias("bytes"))
    return promised, found


@query("j10_promised_emitted", o(f", {_FOUND} SELECT 'missing-file' AS code, file FROM promised WHERE file NOT IN (SELECT file FROM found) UNION ALL SELECT 'empty-file', file FROM promised WHERE file IN (SELECT file FROM found WHERE bytes = 0) UNION ALL SELECT 'unclaimed-file', file FROM found WHERE file LIKE '%.html' AND file NOT IN (SELECT file FROM promised)"))
def j10(spark, d):
    return V.route_checks(*_promised(spark, d))


@query("j11_broken_links", o(", il AS (SELECT DISTINCT page_id, raw, trim(regexp_extract(raw, '^([^?#]*)', 1), '/') AS p FROM refs WHERE tag = 'a' AND starts_with(raw, '/') AND NOT starts_with(raw, '//')), fs AS (SELECT DISTINCT p || CASE WHEN length(p) % 3 = 0 THEN '/index.html' WHEN length(p) % 3 = 1 THEN '.html' ELSE '' END AS file FROM il WHERE length(p) % 4 <> 0) SELECT page_id, raw FROM il WHERE NOT EXISTS (SELECT 1 FROM fs WHERE file IN (p || '/index.html', p, p || '.html'))"))
def j11(spark, d):
    refs = B.refs(spark, d)
    p = F.regexp_replace(U.path_part(F.col("raw")), "^/+|/+$", "")
    n = F.length(p)
    files = refs.filter((F.col("tag") == "a") & (U.scope_of(F.col("raw")) == "internal") & (n % 4 != 0)).select(F.concat(p, F.when(n % 3 == 0, "/index.html").when(n % 3 == 1, ".html").otherwise("")).alias("file")).distinct()
    return V.broken_links(refs, files)


@query("j12_missing_assets", o(_ASSET + " SELECT doc_id, key FROM asset_keys WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM asset_keys WHERE doc_id % 3 = 0 AND key IS NOT NULL)"))
def j12(spark, d):
    t = B.assets(spark, d).select("doc_id", U.identify_asset(F.col("raw"), B.MEDIA)["key"].alias("key")).filter("key is not null")
    return I.missing(t, t.filter("doc_id % 3 = 0").select("key").distinct(), "key").select("doc_id", "key")


_BASE = "fnd AS (SELECT 'check|' || event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity FROM events WHERE event_id % 3 = 0), bas AS (SELECT 'check|' || event_id AS id, 'd' || event_id % 4 AS decision FROM events WHERE event_id % 7 = 0)"


@query("j13_baseline", o(f", {_BASE} SELECT id, CASE WHEN severity = 'error' AND decision IS NOT NULL THEN 'baseline' ELSE severity END AS severity, decision FROM fnd LEFT JOIN bas USING (id) UNION ALL SELECT id, 'stale', decision FROM bas WHERE id NOT IN (SELECT id FROM fnd)"))
def j13(spark, d):
    e = B.table(spark, d, "events").withColumn("id", F.concat(F.lit("check|"), F.col("event_id")))
    f = e.filter("event_id % 3 = 0").select("id", F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"))
    b = e.filter("event_id % 7 = 0").select("id", F.concat(F.lit("d"), F.col("event_id") % 4).alias("decision"))
    return I.apply_baseline(f, b)


@query("j14_bag_difference", o(", a AS (SELECT l_returnflag AS f, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_returnflag AS f, l_quantity::BIGINT AS q, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL), x AS (SELECT coalesce(a.f, b.f) AS flag, coalesce(a.q, b.q) AS quantity, coalesce(a.n, 0) - coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.f = b.f AND a.q = b.q) SELECT flag, quantity, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, abs(n)::BIGINT AS n FROM x WHERE n <> 0"))
def j14(spark, d):
    from ..operators.ordering import bag_difference

    t = B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("quantity"))
    return bag_difference(t.filter("l_orderkey % 2 = 0"), t.filter("l_orderkey % 2 = 1"), ["flag", "quantity"])


@query("j15_capability", o("SELECT p_type AS name, CASE WHEN min(p_partkey) % 4 = 0 THEN 'core' WHEN min(p_partkey) % 4 = 1 THEN 'configured' WHEN min(p_partkey) % 4 = 2 THEN 'withheld' ELSE 'unconfigured' END AS capability FROM part GROUP BY p_type"))
def j15(spark, d):
    t = B.table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("k"))
    prof = t.filter("k % 4 <> 3").select("name", F.when(F.col("k") % 4 == 0, "core").when(F.col("k") % 4 == 1, "configured").otherwise("withheld").alias("p"))
    return t.join(prof, "name", "left").select("name", F.coalesce("p", F.lit("unconfigured")).alias("capability"))


@query("j16_lineage", o("SELECT c_custkey AS id, count(DISTINCT o_orderkey)::BIGINT AS n_routes, coalesce(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR), '') AS routes, count(o_orderkey) = 0 AS withheld FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"))
def j16(spark, d):
    return V.lineage(B.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), B.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("route")))


@query("j17_navigation_targets", o(", nv AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href FROM nv WHERE length(href) % 2 = 1"))
def j17(spark, d):
    nav = B.pages(spark, d).select("page_id", F.explode(F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit('href="([^"]*)"'), 1)).alias("href"))
    return I.missing(nav, nav.filter(F.length("href") % 2 == 0).select("href").distinct(), "href").select("page_id", "href")


@query("j20_redirect_findings", o(r""", pb AS (SELECT DISTINCT CASE WHEN rtrim(regexp_extract(key, '^([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(key, '^([^?#]*)', 1), '/') END AS p FROM local WHERE NOT redirect),
rr AS (SELECT from_path, to_path FROM rules UNION ALL SELECT '/dup', '/dup/' UNION ALL SELECT '/dup', '/en/1/'), ii AS (SELECT *, rtrim(to_path, '/') AS p FROM rr WHERE NOT regexp_matches(to_path, '^[a-z]+://'))
SELECT 'duplicate-source' AS code, from_path, to_path FROM rr WHERE from_path IN (SELECT from_path FROM rr GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'self-redirect', from_path, to_path FROM ii WHERE p = from_path
UNION ALL SELECT 'source-is-published', from_path, to_path FROM rr WHERE from_path IN (SELECT p FROM pb) UNION ALL SELECT 'target-is-a-source', from_path, to_path FROM ii WHERE p <> from_path AND p IN (SELECT from_path FROM rr)
UNION ALL SELECT 'target-not-published', from_path, to_path FROM ii WHERE p <> from_path AND p NOT IN (SELECT from_path FROM rr) AND p NOT IN (SELECT p FROM pb)"""))
def j20(spark, d):
    r = B.rules(spark, d).select("from_path", "to_path").unionByName(spark.createDataFrame([("/dup", "/dup/"), ("/dup", "/en/1/")], "from_path string, to_path string"))
    return V.redirect_findings(r, B.local(spark, d).filter("not redirect").select(U.path_part(F.col("key")).alias("path")))


@query("j21_coverage_gaps", o("SELECT coalesce(a.f, b.f) AS family, CASE WHEN b.f IS NULL THEN 'undocumented' ELSE 'unused' END AS code FROM (SELECT DISTINCT family AS f FROM live) a FULL JOIN (SELECT * FROM (VALUES ('page'), ('media'), ('author'), ('feed')) t(f)) b ON a.f = b.f WHERE a.f IS NULL OR b.f IS NULL"))
def j21(spark, d):
    map_ = spark.createDataFrame([("page",), ("media",), ("author",), ("feed",)], "family string")
    return I.both_ways(B.live(spark, d), map_, "family").select(F.col("key").alias("family"), F.when(F.col("side") == "left-only", "undocumented").otherwise("unused").alias("code"))


@query("j22_fill_missing", o("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, n_name) AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"))
def j22(spark, d):
    s = B.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    e = B.table(spark, d, "supplier").join(F.broadcast(B.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("name"))
    return X.fill_missing(s, e, "s_suppkey", ["name"])


@query("j23_exclusions", o("SELECT doc_id, 'locale-not-built' AS reason FROM posts WHERE locale <> 'en' UNION ALL SELECT doc_id, 'collection-withheld' FROM posts WHERE categories[1] IN ('c1', 'c6')"))
def j23(spark, d):
    p = B.posts(spark, d)
    held = spark.createDataFrame([("c1",), ("c6",)], "category string")
    a = p.filter("locale <> 'en'").select("doc_id", F.lit("locale-not-built").alias("reason"))
    return a.unionByName(p.select("doc_id", F.col("categories")[0].alias("category")).join(F.broadcast(held), "category").select("doc_id", F.lit("collection-withheld").alias("reason")))


@query("j24_pooled_last_wins", o("SELECT l_partkey, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY l_partkey"))
def j24(spark, d):
    t = B.table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return I.last_wins(t, "l_partkey", "pos").select("l_partkey", "price")


@query("j25_plan_captured", o(_ASSET + ", pl AS (SELECT DISTINCT key FROM asset_keys WHERE key IS NOT NULL), cp AS (SELECT key FROM pl WHERE length(key) % 3 <> 0 UNION ALL SELECT 'uploads:extra/' || n_nationkey FROM nation) SELECT key, 'missing' AS code FROM pl WHERE key NOT IN (SELECT key FROM cp) UNION ALL SELECT key, 'unclaimed' FROM cp WHERE key NOT IN (SELECT key FROM pl)"))
def j25(spark, d):
    plan = B.assets(spark, d).select(U.identify_asset(F.col("raw"), B.MEDIA)["key"].alias("key")).filter("key is not null").distinct()
    got = plan.filter(F.length("key") % 3 != 0).unionByName(B.table(spark, d, "nation").select(F.concat(F.lit("uploads:extra/"), F.col("n_nationkey")).alias("key")))
    return I.both_ways(plan, got, "key").select("key", F.when(F.col("side") == "left-only", "missing").otherwise("unclaimed").alias("code"))


@query("j28_unclaimed_files", o("SELECT DISTINCT 'content/' || p_brand || '.json' AS file FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)"))
def j28(spark, d):
    p = B.table(spark, d, "part")
    return I.missing(p.select("p_brand").distinct(), p.filter("p_size > 48").select("p_brand").distinct(), "p_brand").select(F.concat(F.lit("content/"), F.col("p_brand"), F.lit(".json")).alias("file"))


@query("j30_palette_pairs", o(f", {_PAL} SELECT p.p_partkey, CASE WHEN q.a IS NULL THEN 'missing-token' ELSE 'known' END AS state FROM pal p LEFT JOIN (SELECT p_partkey, a FROM pal WHERE p_partkey % 3 = 0) q ON q.p_partkey = p.p_partkey - 1"))
def j30(spark, d):
    p = B.table(spark, d, "part").select("p_partkey")
    pal = p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 1).alias("p_partkey"), F.lit(True).alias("a"))
    return p.join(pal, "p_partkey", "left").select("p_partkey", F.when(F.col("a").isNull(), "missing-token").otherwise("known").alias("state"))


@query("j31_registry_parents", o("SELECT slug, CASE WHEN slug = parent THEN 'self-parent' ELSE 'unknown-parent' END AS code FROM broken_terms b WHERE slug = parent OR (parent IS NOT NULL AND parent NOT IN (SELECT slug FROM broken_terms))"))
def j31(spark, d):
    t = B.broken_terms(spark, d)
    lost = t.filter("parent is not null").join(t.select(F.col("slug").alias("parent")), "parent", "left_anti").select("slug", F.lit("unknown-parent").alias("code"))
    return t.filter("slug = parent").select("slug", F.lit("self-parent").alias("code")).unionByName(lost)


@query("j32_not_migrated", o("SELECT page_id FROM live WHERE EXISTS (SELECT 1 FROM (VALUES ('/en/1'), ('/de'), ('/fr/25')) t(p) WHERE rtrim(path, '/') = p OR starts_with(path, p || '/'))"))
def j32(spark, d):
    p = U.path_part(F.col("key"))
    cond = F.lit(False)
    for x in ("/en/1", "/de", "/fr/25"):
        cond |= (U.trim_slashes(p) == x) | p.startswith(x + "/")
    return B.live(spark, d).filter(cond).select("page_id")
