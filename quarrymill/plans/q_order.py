"""Ordered computation, top-k and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import hierarchy as Y
from ..operators import identity as I
from ..operators import ordering as W
from . import bridge as B
from .registry import query

o = B.oracle


@query("w01_paginate", o(", gr AS (SELECT DISTINCT author AS g FROM posts UNION ALL SELECT 'nobody'), t AS (SELECT g, count(doc_id)::BIGINT AS total FROM gr LEFT JOIN posts ON author = g GROUP BY g), c AS (SELECT *, greatest(1, ceil(total / 10))::BIGINT AS page_count FROM t), p AS (SELECT *, unnest(range(1, page_count + 1)) AS page FROM c) SELECT g AS author, page, page_count, total, CASE WHEN total = 0 THEN 0 ELSE (page - 1) * 10 + 1 END::BIGINT AS first, least(total, page * 10)::BIGINT AS last, page > 1 AS has_previous, page < page_count AS has_next FROM p"))
def w01(spark, d):
    p = B.posts(spark, d)
    groups = p.select("author").distinct().unionByName(spark.createDataFrame([("nobody",)], "author string"))
    return W.paginate(p, "author", [F.desc("published"), F.col("slug")], 10, groups)


@query("w01_page_items", o("SELECT doc_id, author, rn AS rank, ceil(rn / 10)::BIGINT AS page FROM (SELECT doc_id, author, row_number() OVER (PARTITION BY author ORDER BY published DESC, slug) AS rn FROM posts)"))
def w01b(spark, d):
    return W.page_of(B.posts(spark, d), "author", [F.desc("published"), F.col("slug")], 10).select("doc_id", "author", "rank", "page")


_OUT = "ol AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 4] WHEN 2 THEN [1, 3, 1] WHEN 3 THEN [] ELSE [1, 2, 5, 6] END AS v FROM documents)"


@query("w02_heading_outline", o(f""", {_OUT}, oi AS (SELECT doc_id, v, unnest(range(2, len(v) + 1)) AS i FROM ol)
SELECT doc_id, 'no-h1' AS code, '' AS detail FROM ol WHERE NOT list_contains(v, 1) UNION ALL SELECT doc_id, 'multiple-h1', len(list_filter(v, lambda x: x = 1))::VARCHAR FROM ol WHERE len(list_filter(v, lambda x: x = 1)) > 1
UNION ALL SELECT doc_id, 'starts-below-h1', v[1]::VARCHAR FROM ol WHERE len(v) > 0 AND v[1] <> 1 UNION ALL SELECT doc_id, 'skipped-level', v[i - 1] || '>' || v[i] FROM oi WHERE v[i] > v[i - 1] + 1"""))
def w02(spark, d):
    m = F.col("doc_id") % 5
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    v = F.when(m == 0, arr(1, 2, 3)).when(m == 1, arr(2, 4)).when(m == 2, arr(1, 3, 1)).when(m == 3, F.array().cast("array<int>")).otherwise(arr(1, 2, 5, 6))
    return W.outline_issues(B.table(spark, d, "documents").select("doc_id", v.alias("v")), "v", "doc_id")


@query("w04_anchor_numbers", o("SELECT doc_id, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS anchor FROM (SELECT doc_id, source, 'a' || doc_id % 3 AS base, row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) - 1 AS n FROM documents)"))
def w04(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("a"), F.col("doc_id") % 3).alias("base"))
    return W.numbered_anchors(t, "source", "base", "doc_id").select("doc_id", "anchor")


@query("w05_first_claim", o("SELECT doc_id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(body)) AS kept FROM posts) WHERE doc_id <> kept"))
def w05(spark, d):
    t = B.posts(spark, d).select("doc_id", F.md5("body").alias("k"))
    return I.first_wins(t, "k", "doc_id")[1].select("doc_id", "kept")


@query("w06_even_sample", o("SELECT author, doc_id FROM (SELECT author, doc_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY author) AS n FROM posts WINDOW w AS (PARTITION BY author ORDER BY slug)) WHERE n <= 6 OR list_contains(list_transform(range(6), lambda j: floor(j * (n - 1) / 5 + 0.5)::INT), i)"))
def w06(spark, d):
    return W.evenly_spaced(B.posts(spark, d).select("author", "slug", "doc_id"), "author", "slug", 6).select("author", "doc_id")


@query("w08_best_match", o(", mt AS (SELECT l_orderkey AS k, l_quantity::INT % 4 AS w, CASE l_linenumber % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'page' ELSE 'tag' END AS f FROM lineitem), tp AS (SELECT k, list_sort(list(DISTINCT f)) AS s FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY w DESC) AS r FROM mt) WHERE r = 1 GROUP BY k) SELECT k, CASE WHEN len(s) = 1 THEN s[1] WHEN s = ['page', 'post'] THEN 'entry' ELSE 'unknown' END AS family FROM tp"))
def w08(spark, d):
    m = F.col("l_linenumber") % 3
    t = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity").cast("int") % 4).alias("w"), F.when(m == 0, "post").when(m == 1, "page").otherwise("tag").alias("f"))
    return W.best_by_weight(t, "k", "w", "f")


@query("w09_page_window", o(", pw AS (SELECT doc_id, 1 + doc_id % 12 AS l, 1 + doc_id % (1 + doc_id % 12) AS c FROM documents), nr AS (SELECT *, CASE WHEN l <= 7 THEN range(1, l + 1) ELSE list_filter(range(1, l + 1), lambda p: p = 1 OR p = l OR abs(p - c) <= 2) END AS v FROM pw) SELECT doc_id, array_to_string(flatten(list_transform(v, lambda p, i: CASE WHEN i > 1 AND p - v[i - 1] > 1 THEN [0, p] ELSE [p] END)), ' ') AS pages FROM nr"))
def w09(spark, d):
    last = (1 + F.col("doc_id") % 12).cast("int")
    t = B.table(spark, d, "documents").select("doc_id", last.alias("l"), (1 + F.col("doc_id") % last).cast("int").alias("c"))
    return t.select("doc_id", F.array_join(W.page_window(F.col("c"), F.col("l")), " ").alias("pages"))


@query("w10_running_duplicates", o("SELECT doc_id, nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY cluster, locale ORDER BY doc_id) AS nth FROM posts) WHERE nth > 1"))
def w10(spark, d):
    t = B.posts(spark, d).select("doc_id", F.concat_ws("@", "cluster", "locale").alias("k"))
    return I.repeats(t, "k", "doc_id").select("doc_id", F.col("nth").cast("long").alias("nth"))


@query("w11_first_match", o("SELECT page_id, (SELECT arg_min(prefix, ord) FROM splats WHERE starts_with(path, prefix)) AS splat FROM live"))
def w11(spark, d):
    s = spark.createDataFrame(list(B.SPLATS), "prefix string, ord int")
    t = B.live(spark, d).select("page_id", U.path_part(F.col("key")).alias("path"))
    m = t.join(F.broadcast(s), F.col("path").startswith(F.col("prefix")), "left")
    return m.groupBy("page_id").agg(F.min_by("prefix", "ord").alias("splat"))


@query("t01_entry_sort", o("SELECT rank, doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY locale ORDER BY title, slug) AS rank FROM posts)"))
def t01(spark, d):
    return W.page_of(B.posts(spark, d), "locale", [F.col("title"), F.col("slug")], 10).select("rank", "doc_id")


@query("t02_post_order", o("SELECT doc_id, row_number() OVER (PARTITION BY author ORDER BY CASE WHEN doc_id % 6 <> 0 THEN published END DESC NULLS LAST, slug) AS rank FROM posts"))
def t02(spark, d):
    t = B.posts(spark, d).withColumn("p", F.when(F.col("doc_id") % 6 != 0, F.col("published")))
    return W.page_of(t, "author", [F.desc_nulls_last("p"), F.col("slug")], 10).select("doc_id", "rank")


@query("t03_latest_posts", o("SELECT doc_id, published::VARCHAR AS published FROM posts p WHERE locale = 'en' ORDER BY p.published DESC, slug LIMIT 5"))
def t03(spark, d):
    return B.posts(spark, d).filter("locale = 'en'").orderBy(F.desc("published"), "slug").limit(5).select("doc_id", F.col("published").cast("string").alias("published"))


@query("t03_top_k_per_group", o("SELECT c_custkey, o_orderkey, rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"))
def t03b(spark, d):
    t = B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return W.top_k(t, "c_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("c_custkey", "o_orderkey", "rank")


@query("t04_enumerated_sort", o("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 0 END, event_id) AS rank FROM events"))
def t04(spark, d):
    return W.page_of(B.table(spark, d, "events"), "user_id", [W.enumerated_order(F.col("event_type"), ("error", "click", "view")), F.col("event_id")], 10).select("event_id", "rank")


@query("t05_inventory_sort", o("SELECT file, redirect FROM local ORDER BY file"))
def t05(spark, d):
    return B.local(spark, d).orderBy("file").select("file", "redirect")


_CH = "ch AS (SELECT slug, parent, [slug] AS chain FROM {t} WHERE parent IS NULL UNION ALL SELECT t.slug, t.parent, list_append(ch.chain, t.slug) FROM {t} t JOIN ch ON t.parent = ch.slug)"


@query("h01_term_chain", o(f", {_CH.format(t='terms')} SELECT slug, array_to_string(chain, '/') AS chain FROM ch"))
def h01(spark, d):
    return Y.chains(B.terms(spark, d)).filter("state = 'ok'").select("slug", F.array_join("chain", "/").alias("chain"))


@query("h02_page_parents", o(", pp AS (SELECT doc_id AS id, doc_id AS pos, 0 AS depth FROM documents UNION ALL SELECT id, (pos - 1) // 3, depth + 1 FROM pp WHERE pos > 0) SELECT id AS doc_id, max(depth)::BIGINT AS depth FROM pp GROUP BY 1"))
def h02(spark, d):
    t = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3).cast("string")).alias("parent"))
    return Y.chains(t).select(F.col("slug").cast("long").alias("doc_id"), (F.size("chain") - 1).cast("long").alias("depth"))


@query("h03_parent_issues", o("SELECT * FROM (VALUES ('x1', 'unknown-parent'), ('x2', 'self-parent'), ('x3', 'cycle'), ('x4', 'cycle'), ('x5', 'cycle')) t(slug, code)"))
def h03(spark, d):
    return Y.parent_issues(B.broken_terms(spark, d))


@query("h04_tolerant_walk", o(f", {_CH.format(t='terms')} SELECT slug, len(chain)::BIGINT AS ancestors FROM ch UNION ALL SELECT 'x1', 1"))
def h04(spark, d):
    return Y.chains(B.broken_terms(spark, d)).filter("state <> 'cycle'").select("slug", F.size("chain").cast("long").alias("ancestors"))


@query("f05_term_path", o(f", {_CH.format(t='terms')} SELECT slug, '/topics/' || array_to_string(chain, '/') || '/' AS path FROM ch"))
def f05(spark, d):
    return Y.term_paths(B.terms(spark, d), "topics", True)


@query("a27_menu_depth", o(f", {_CH.format(t='terms')} SELECT chain[1] AS menu, max(len(chain))::BIGINT AS depth, count(*)::BIGINT AS items FROM ch GROUP BY 1"))
def a27(spark, d):
    return Y.tree_depth(Y.chains(B.terms(spark, d)).withColumn("menu", F.col("chain")[0]), "menu", "chain")


@query("h05_current_items", o(f", {_CH.format(t='terms')} SELECT slug, slug IN (SELECT unnest(chain) FROM ch WHERE slug IN ('s4', 'n7')) AS contains_current FROM ch"))
def h05(spark, d):
    t = Y.chains(B.terms(spark, d)).withColumn("menu", F.col("chain")[0]).withColumn("current", F.col("slug").isin("s4", "n7"))
    return Y.current_items(t, "menu", "chain", "current").select("slug", "contains_current")
