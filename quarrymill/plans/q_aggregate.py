"""Aggregations and duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..operators import identity as I
from ..operators import inventory as V
from ..operators import ordering as W
from ..operators import transform as X
from . import bridge as B
from .q_scalar import _BUILDER, _MARKED, marked
from .q_join import _DIFF, diffed
from .q_scalar import _ASSET
from .registry import query

o = B.oracle


def number():
    return F.count(F.lit(1)).alias("n")


@query("a01_count_by_kind", o("SELECT k AS kind, count(event_id)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('refund')) t(k) LEFT JOIN events ON event_type = k GROUP BY k"))
def a01(spark, d):
    kinds = spark.createDataFrame([("click",), ("view",), ("refund",)], "kind string")
    c = B.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(number())
    return kinds.join(c, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a02_diff_counts", o(_DIFF + ", cl AS (SELECT * FROM (VALUES ('MATCH'), ('REDIRECT'), ('RETIRED'), ('INFRASTRUCTURE'), ('GAP'), ('LOCAL_ONLY')) t(classification)) SELECT classification, count(key)::BIGINT AS n FROM cl LEFT JOIN diff USING (classification) GROUP BY 1"))
def a02(spark, d):
    return V.counts(spark, diffed(spark, d))


@query("a03_route_counts", o("SELECT count(*)::BIGINT AS total, count(*) FILTER (family = 'page')::BIGINT AS pages, count(*) FILTER (family = 'media')::BIGINT AS media, count(*) FILTER (family = 'feed')::BIGINT AS feeds FROM live"))
def a03(spark, d):
    return B.live(spark, d).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("family") == f).alias(a) for f, a in (("page", "pages"), ("media", "media"), ("feed", "feeds"))])


@query("a04_redirect_families", o("SELECT f AS family, count(*)::BIGINT AS n FROM (SELECT string_split(from_path, '/')[2] AS f FROM rules UNION ALL SELECT substr(prefix, 2) FROM splats) GROUP BY 1"))
def a04(spark, d):
    s = spark.createDataFrame(list(B.SPLATS), "prefix string, ord int").select(F.substring("prefix", 2, 100).alias("family"))
    return B.rules(spark, d).select(F.split("from_path", "/")[1].alias("family")).unionByName(s).groupBy("family").agg(number())


_SOLE = "SELECT {k} AS key, count(*)::BIGINT AS n, string_agg({b}::VARCHAR, ',' ORDER BY {b}::VARCHAR) AS claimants FROM {t} GROUP BY 1 HAVING count(*) > 1"


@query("a05_sole_claimant", o(_SOLE.format(k="sha256(body)", b="doc_id", t="posts")))
def a05(spark, d):
    return I.sole_claimant(B.posts(spark, d), F.sha2("body", 256), "doc_id")


@query("a06_entry_identity", o(_SOLE.format(k="'posts/doc-' || doc_id % 300 || '@' || locale", b="doc_id", t="posts")))
def a06(spark, d):
    return I.sole_claimant(B.posts(spark, d), U.entry_id(F.lit("posts"), F.concat(F.lit("doc-"), F.col("doc_id") % 300), F.col("locale")), "doc_id")


@query("a06_contested_sources", o(_SOLE.format(k="'wp:post/post#' || doc_id % 500", b="slug", t="posts")))
def a06b(spark, d):
    return I.sole_claimant(B.posts(spark, d), U.source_key(F.lit("post"), F.lit("post"), F.col("doc_id") % 500, F.lit(None).cast("string")), "slug")


@query("a07_duplicate_paths", o("SELECT regexp_extract(key, '^([^?#]*)', 1) AS path, count(*)::BIGINT AS n FROM k_ GROUP BY 1 HAVING count(*) > 1"))
def a07(spark, d):
    return B.pages(spark, d).select(U.path_part(U.comparison_key(F.col("url"))).alias("path")).groupBy("path").agg(number()).filter("n > 1")


@query("a08_cluster_issues", o(""", m AS (SELECT *, row_number() OVER (PARTITION BY cluster, locale ORDER BY doc_id) AS nth FROM posts), s AS (SELECT cluster, min(CASE WHEN locale = 'en' THEN doc_id END) AS sid FROM posts GROUP BY cluster)
SELECT cluster, 'duplicate-locale' AS code, locale || ':' || doc_id AS detail FROM m WHERE nth > 1 UNION ALL SELECT cluster, 'missing-source', 'en' FROM s WHERE sid IS NULL
UNION ALL SELECT m.cluster, 'slug-mismatch', m.doc_id || ':' || 's' || m.doc_id % 3 FROM m JOIN s ON s.cluster = m.cluster AND sid IS NOT NULL WHERE m.doc_id % 3 <> sid % 3"""))
def a08(spark, d):
    p = B.posts(spark, d).select("cluster", "locale", F.concat(F.lit("s"), F.col("doc_id") % 3).alias("slug"), F.col("doc_id").alias("id"))
    return I.cluster_issues(p, "en")


@query("a09_body_report", o("""SELECT count(*)::BIGINT AS n, min(l)::BIGINT AS least, max(l)::BIGINT AS most, floor(median(l) + 0.5)::BIGINT AS middle, count(*) FILTER (l < floor(md + 0.5) * 0.2)::BIGINT AS short
FROM (SELECT length(body) AS l, (SELECT median(length(body)) FROM posts) AS md FROM posts)"""))
def a09(spark, d):
    b = B.posts(spark, d).select(F.col("doc_id").alias("id"), F.length("body").alias("length"), F.lit(None).cast("string").alias("builder"))
    return W.body_report(b).agg(F.count(F.lit(1)).alias("n"), F.min("length").cast("long").alias("least"), F.max("length").cast("long").alias("most"), W.median_half_up("length").alias("middle"), F.count_if(F.col("reason") == "short").alias("short"))


@query("a09_body_reasons", o("SELECT doc_id AS id, CASE WHEN l < floor(m + 0.5) * 0.2 THEN 'short' WHEN doc_id % 9 = 0 THEN 'builder' END AS reason FROM (SELECT doc_id, length(body) AS l, median(length(body)) OVER (PARTITION BY locale) AS m FROM posts)"))
def a09b(spark, d):
    b = B.posts(spark, d).select(F.col("doc_id").alias("id"), "locale", F.length("body").alias("length"), F.when(F.col("doc_id") % 9 == 0, "divi").alias("builder"))
    return W.body_report(b, "locale").select("id", "reason")


@query("a10_duplicate_titles", o("SELECT title, count(*)::BIGINT AS n, min(page_id) AS first, string_agg(page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) AS files FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages) GROUP BY title HAVING count(*) > 1"))
def a10(spark, d):
    t = B.pages(spark, d).select("page_id", H.title_of(F.col("html")).alias("title"))
    return t.groupBy("title").agg(number(), F.min("page_id").alias("first"), F.array_join(F.array_sort(F.collect_list(F.col("page_id").cast("string"))), ",").alias("files")).filter("n > 1")


@query("a11_asset_rollup", o(_ASSET + " SELECT key, count(*)::BIGINT AS n, count(DISTINCT nullif(host, ''))::BIGINT AS hosts FROM asset_keys WHERE key IS NOT NULL GROUP BY key"))
def a11(spark, d):
    a = B.assets(spark, d).select(U.identify_asset(F.col("raw"), B.MEDIA).alias("a")).select("a.*").filter("key is not null")
    return a.groupBy("key").agg(number(), F.countDistinct(F.when(F.col("host") != "", F.col("host"))).alias("hosts"))


@query("a11_asset_classes", o(_ASSET + " SELECT classification, count(*)::BIGINT AS n FROM asset_ids GROUP BY 1"))
def a11b(spark, d):
    return B.assets(spark, d).select(U.identify_asset(F.col("raw"), B.MEDIA)["classification"].alias("classification")).groupBy("classification").agg(number())


@query("a12_majority_chrome", o("""SELECT event_type AS name FROM (SELECT f, event_type FROM (SELECT DISTINCT user_id % 3 AS f, user_id, event_type FROM events) JOIN (SELECT user_id % 3 AS f2, count(DISTINCT user_id) AS n FROM events GROUP BY 1) ON f2 = f GROUP BY f, event_type, n HAVING count(*) * 2 > n) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT user_id % 3) FROM events)"""))
def a12(spark, d):
    e = B.table(spark, d, "events").select((F.col("user_id") % 3).alias("family"), F.col("user_id").alias("page"), F.col("event_type").alias("name"))
    return W.majority_then_all(e, "family", "page", "name")


@query("a13_vague_prefixes", o(""", sg AS (SELECT list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM live WHERE family IN ('entry', 'unknown', 'page')), px AS (SELECT unnest(['/' || s[1] || '/', '/' || s[1] || '/' || s[2] || '/']) AS prefix FROM sg WHERE len(s) >= 2)
SELECT prefix, count(*)::BIGINT AS n FROM px GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, prefix LIMIT 5"""))
def a13(spark, d):
    return V.vague_prefixes(B.live(spark, d), least=2)


@query("a14_rule_counts", o("SELECT code, count(*)::BIGINT AS n FROM (SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 5000 THEN 'long' ELSE 'fine' END AS code FROM documents) GROUP BY 1"))
def a14(spark, d):
    return B.table(spark, d, "documents").groupBy(F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") > 5000, "long").otherwise("fine").alias("code")).agg(number())


@query("a15_verdict", o("SELECT o_orderpriority AS candidate, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'blocked' WHEN bool_or(o_orderstatus = 'P') THEN 'unresolved' ELSE 'ready' END AS verdict, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS failing FROM orders GROUP BY 1"))
def a15(spark, d):
    s = F.col("o_orderstatus")
    return B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("candidate")).agg(F.when(F.bool_or(s == "F"), "blocked").when(F.bool_or(s == "P"), "unresolved").otherwise("ready").alias("verdict"), F.count_if(s == "F").alias("failing"))


@query("a16_census_totals", o("SELECT count(c)::BIGINT AS reachable, sum(c)::BIGINT AS total, count(*) FILTER (c IS NULL)::BIGINT AS refused FROM (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS c FROM part)"))
def a16(spark, d):
    c = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    return B.table(spark, d, "part").agg(F.count(c).alias("reachable"), F.sum(c).cast("long").alias("total"), F.count_if(c.isNull()).alias("refused"))


@query("a17_audit_counters", o("SELECT count(*) FILTER (html LIKE '%<title>%')::BIGINT AS titles, sum(len(regexp_extract_all(html, '(?i)<h[1-6]\\b')))::BIGINT AS headings, sum(len(regexp_extract_all(html, '(?i)<a\\b')))::BIGINT AS links, sum(len(regexp_extract_all(html, '(?i)<nav\\b')))::BIGINT AS navs FROM pages"))
def a17(spark, d):
    h = F.col("html")
    n = lambda p, a: F.sum(F.regexp_count(h, F.lit(p))).cast("long").alias(a)
    return B.pages(spark, d).agg(F.count_if(h.contains("<title>")).alias("titles"), n(r"(?i)<h[1-6]\b", "headings"), n(r"(?i)<a\b", "links"), n(r"(?i)<nav\b", "navs"))


@query("a18_gaps_by_family", o(_DIFF + " SELECT family, count(*)::BIGINT AS n FROM diff WHERE classification = 'GAP' GROUP BY 1"))
def a18(spark, d):
    return diffed(spark, d).filter("classification = 'GAP'").groupBy("family").agg(number())


@query("a19_builder_histogram", o(f"SELECT builder, count(*)::BIGINT AS n FROM (SELECT {_BUILDER} AS builder FROM {_MARKED}) WHERE builder IS NOT NULL GROUP BY 1"))
def a19(spark, d):
    return marked(spark, d).select(T.builder_of(F.col("m")).alias("builder")).filter("builder is not null").groupBy("builder").agg(number())


_CAP = """cap AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 9 THEN 'page' ELSE 'post' END AS kind, CASE WHEN doc_id % 8 = 0 THEN 'draft' ELSE 'publish' END AS status, doc_id % 13 = 0 AS protected, text AS body, CASE WHEN doc_id % 17 = 0 THEN 'Bad Slug' ELSE 'doc-' || doc_id % 400 END AS slug,
  CASE WHEN doc_id % 19 <> 0 THEN '2024-01-02T10:00:00' END AS date, CASE WHEN doc_id % 38 = 0 THEN '2024-02-03' END AS modified, CASE WHEN doc_id % 23 <> 0 THEN string_split(text, chr(10))[1] ELSE ' &nbsp; ' END AS title, CASE WHEN doc_id % 29 <> 0 THEN source END AS author, doc_id % 31 = 0 AS nocat FROM documents),
c1 AS (SELECT *, CASE WHEN status <> 'publish' THEN 'not-published' WHEN protected THEN 'password-protected' WHEN coalesce(body, '') = '' THEN 'incomplete' WHEN slug = 'Bad Slug' THEN 'unrepresentable-slug' WHEN date IS NULL AND modified IS NULL THEN 'incomplete'
  WHEN trim(regexp_replace(replace(title, '&nbsp;', ' '), '[\\s\\p{Z}]+', ' ', 'g')) = '' THEN 'incomplete' WHEN kind = 'post' AND (date IS NULL OR author IS NULL OR nocat) THEN 'incomplete' END AS r FROM cap),
ladder AS (SELECT id, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY kind, slug, r IS NULL ORDER BY id) > 1 THEN 'duplicate-slug' ELSE r END AS reason FROM c1)"""


def captured(spark, d):
    i = F.col("doc_id")
    return B.table(spark, d, "documents").select(
        i.alias("id"), F.when(i % 10 == 9, "page").otherwise("post").alias("kind"), F.when(i % 8 == 0, "draft").otherwise("publish").alias("status"), (i % 13 == 0).alias("protected"), F.col("text").alias("body"), F.when(i % 17 == 0, "Bad Slug").otherwise(F.concat(F.lit("doc-"), i % 400)).alias("slug"),
        F.when(i % 19 != 0, "2024-01-02T10:00:00").alias("date"), F.when(i % 38 == 0, "2024-02-03").alias("modified"), F.when(i % 23 != 0, F.split("text", "\n", 2)[0]).otherwise(" &nbsp; ").alias("title"), F.when(i % 29 != 0, F.col("source")).alias("author"), F.when(i % 31 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("categories"), i.alias("pos"),
    )


@query("a20_conservation", o(f", {_CAP} SELECT count(*)::BIGINT AS held, count(*) FILTER (reason IS NULL)::BIGINT AS made, count(reason)::BIGINT AS excluded, true AS sound FROM ladder"))
def a20(spark, d):
    c = captured(spark, d)
    return X.conservation(c, X.ladder(c))


@query("a21_collection_summary", o("SELECT categories[1] AS collection, count(*)::BIGINT AS entries, count(*) FILTER (doc_id % 5 <> 0)::BIGINT AS routed FROM posts GROUP BY 1"))
def a21(spark, d):
    return B.posts(spark, d).groupBy(F.col("categories")[0].alias("collection")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("doc_id") % 5 != 0).alias("routed"))


@query("a22_phrase_counts", o("SELECT p AS phrase, count(DISTINCT doc_id)::BIGINT AS n FROM (VALUES ('the '), ('tion'), (' de '), ('zzzz')) t(p) LEFT JOIN documents ON contains(text, p) GROUP BY p"))
def a22(spark, d):
    phrases = ("the ", "tion", " de ", "zzzz")
    one = B.table(spark, d, "documents").agg(*[F.count_if(F.col("text").contains(p)).alias(f"p{i}") for i, p in enumerate(phrases)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n")) for i, p in enumerate(phrases)])).alias("x")).select("x.phrase", "x.n")


@query("a23_distinct_shapes", o("SELECT tag, array_to_string(list_sort(list(DISTINCT page_id % 10)), ',') AS files FROM refs GROUP BY tag"))
def a23(spark, d):
    return B.refs(spark, d).groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set(F.col("page_id") % 10)), ",").alias("files"))


@query("a24_fingerprint", o("SELECT sha256(string_agg(n_name || chr(10) || sha256(n_regionkey::VARCHAR), chr(10) ORDER BY n_name)) AS fingerprint FROM nation"))
def a24(spark, d):
    return I.fingerprint(B.table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("v")), "n_name", "v")


@query("a26_distinct_last", o("SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source"))
def a26(spark, d):
    return I.last_wins(B.table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("a28_crawl_integrity", o("SELECT count(*)::BIGINT AS rows, count(DISTINCT key)::BIGINT AS keys, count(*) FILTER (page_id % 6 = 0)::BIGINT AS never_fetched, count(*) FILTER (page_id % 6 = 1)::BIGINT AS no_answer, count(*) FILTER (page_id % 6 IN (2, 3))::BIGINT AS refused FROM k_"))
def a28(spark, d):
    m = F.col("page_id") % 6
    status = F.when(m == 1, 0).when(m == 2, 403).when(m == 3, 429).when(m > 3, 200)
    return V.integrity(B.pages(spark, d).select(U.comparison_key(F.col("url")).alias("key"), status.alias("status")))


@query("a29_outline_counts", o("SELECT page_id, len(regexp_extract_all(html, '(?i)<h1\\b'))::BIGINT AS h1, len(regexp_extract_all(html, '(?i)<(?:header|nav|main|footer)\\b'))::BIGINT AS landmarks FROM pages"))
def a29(spark, d):
    h = F.col("html")
    return B.pages(spark, d).select("page_id", F.size(F.filter(H.heading_levels(h), lambda x: x == 1)).cast("long").alias("h1"), F.size(H.landmarks(h)).cast("long").alias("landmarks"))
