"""Two-sided inventory comparison: crawl against build, intended against emitted, promised against found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

# Classes of the comparison.
CLASSES = ("MATCH", "REDIRECT", "RETIRED", "INFRASTRUCTURE", "GAP", "LOCAL_ONLY")


def _rules(rules: DataFrame, published: DataFrame) -> DataFrame:
    """path_, to_path, there_: one rule a source path, the last by ord (or by place); does this build publish its target?"""
    place = F.col("ord") if "ord" in rules.columns else F.monotonically_increasing_id()
    r = rules.select(U.trim_slashes(U.path_part(F.col("from_path"))).alias("path_"), "to_path", place.alias("o_"))
    r = r.groupBy("path_").agg(F.max_by("to_path", "o_").alias("to_path"))
    spelled = F.array(F.col("to_path"), F.concat(U.trim_slashes(U.path_part(F.col("to_path"))), F.lit("/")))
    found = r.select("path_", F.explode(F.array_distinct(spelled)).alias("p_")).join(published, "p_", "left_semi").select("path_").distinct()
    r = r.join(found.withColumn("f_", F.lit(True)), "path_", "left")
    return r.select("path_", "to_path", (~F.col("to_path").startswith("/") | F.col("f_").isNotNull()).alias("there_"))


def diff(live: DataFrame, local: DataFrame, rules: DataFrame, splats: tuple[tuple[str, int], ...], retired: tuple[str, ...], links: U.Permalinks = U.Permalinks()) -> DataFrame:
    """key, family, classification, redirect_target: a row for every key of either side but local redirects.

    live: key, family; local: key, redirect; rules: from_path, to_path and perhaps ord. Rules meet their targets first, then the
    crawl joins the build by key and the rules by trimmed path; the splats are configuration and become a literal ladder, first
    match first, by plain string prefix.
    """
    published = local.filter(~F.col("redirect")).select(F.col("key").alias("p_"))
    t = live.withColumn("path_", U.trim_slashes(U.path_part(F.col("key"))))
    t = t.join(local.select("key", F.col("redirect").alias("stub_")), "key", "left").join(_rules(rules, published), "path_", "left")
    splat = F.lit(False)
    for prefix, _ in splats:
        splat = splat | F.col("path_").startswith(prefix.rstrip("/") or "/")
    cls = (
        F.when(~F.col("stub_"), "MATCH")
        .when(F.col("to_path").isNotNull(), F.when(F.col("there_"), "REDIRECT").otherwise("GAP"))
        .when(splat, "REDIRECT")
        .when(F.col("family").isin(*retired), "RETIRED")
        .when(F.col("family").isin(*U.INFRASTRUCTURE), "INFRASTRUCTURE")
        .otherwise("GAP")
    )
    rows = t.select("key", "family", cls.alias("classification"), F.when(F.coalesce(F.col("stub_"), F.lit(True)), F.col("to_path")).alias("redirect_target"))
    only = local.filter(~F.col("redirect")).join(live.select("key"), "key", "left_anti")
    return rows.unionByName(only.select("key", U.classify_family(F.col("key"), links).alias("family"), F.lit("LOCAL_ONLY").alias("classification"), F.lit(None).cast("string").alias("redirect_target")))


def counts(spark, rows: DataFrame) -> DataFrame:
    """Rows by class, classes without rows included."""
    every = spark.createDataFrame([(c,) for c in CLASSES], "classification string")
    return every.join(rows.groupBy("classification").agg(F.count(F.lit(1)).alias("n")), "classification", "left").select("classification", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def integrity(crawl: DataFrame) -> DataFrame:
    """One row of counts that decide whether a crawl can be trusted. crawl: key, status (null: never fetched, 0: no answer)."""
    n = lambda c, a: F.count_if(c).alias(a)
    return crawl.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"), n(F.col("status").isNull(), "never_fetched"), n(F.col("status") == 0, "no_answer"), n(F.col("status").isin(403, 429), "refused"))


def vague_prefixes(classified: DataFrame, least: int = 5, top: int = 5) -> DataFrame:
    """prefix, n: frequent path prefixes of depth 1 and 2 among keys of vague families; a top-k report by design."""
    seg = U.segments(U.path_part(F.col("key")))
    t = classified.filter(F.col("family").isin("entry", "unknown", "page")).select(seg.alias("s")).filter(F.size("s") >= 2)
    each = t.select(F.explode(F.array(F.concat(F.lit("/"), F.col("s")[0], F.lit("/")), F.concat(F.lit("/"), F.col("s")[0], F.lit("/"), F.col("s")[1], F.lit("/")))).alias("prefix"))
    return each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "prefix").limit(top)


def content_integrity(intended: DataFrame, emitted: DataFrame, files: DataFrame, exclusions: DataFrame) -> DataFrame:
    """code, id: intended (id), emitted (id, path, file), files (file), exclusions (id). Structural ids (@...) are not asked of the output."""
    first = emitted.groupBy("id").agg(F.min(F.struct("path", "file")).alias("r"), F.countDistinct("path").alias("paths"))
    say = lambda d, code: d.select(F.lit(code).alias("code"), "id")
    lost = intended.select("id").distinct().join(first, "id", "left").join(exclusions.select("id").distinct().withColumn("out", F.lit(True)), "id", "left")
    gone = lost.filter("r is null and out is null")
    seen = first.select("id", F.col("r.file").alias("file")).join(files, "file", "left_anti").select("id")
    extra = first.filter(~F.col("id").startswith("@")).join(intended.select("id"), "id", "left_anti").select("id")
    unused = exclusions.select("id").distinct().join(first.select("id"), "id", "left_semi")
    twice = first.filter("paths > 1").filter(~F.col("id").startswith("@")).select("id")
    return say(gone, "SOURCE_ONLY").unionByName(say(seen, "FILE_MISSING")).unionByName(say(extra, "OUTPUT_ONLY")).unionByName(say(unused, "UNUSED_EXCLUSION")).unionByName(say(twice, "IDENTITY_CONTESTED"))


def redirect_findings(rules: DataFrame, published: DataFrame) -> DataFrame:
    """code, from_path, to_path. rules: from_path, to_path; published: path."""
    say = lambda d, code: d.select(F.lit(code).alias("code"), "from_path", "to_path")
    sources = rules.select(F.col("from_path").alias("p_")).distinct()
    n = rules.groupBy("from_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("from_path")
    inner = rules.filter(~F.col("to_path").rlike("^[a-z]+://")).withColumn("p_", U.trim_slashes(F.col("to_path")))
    chain = inner.filter(F.col("p_") != F.col("from_path")).join(sources, "p_", "left_semi")
    live = published.select(U.trim_slashes(F.col("path")).alias("p_")).distinct()
    lost = inner.filter(F.col("p_") != F.col("from_path")).join(sources, "p_", "left_anti").join(live, "p_", "left_anti")
    shadow = rules.withColumn("p_", F.col("from_path")).join(live, "p_", "left_semi")
    return say(rules.join(n, "from_path", "left_semi"), "duplicate-source").unionByName(say(inner.filter(F.col("p_") == F.col("from_path")), "self-redirect")).unionByName(say(shadow, "source-is-published")).unionByName(say(chain, "target-is-a-source")).unionByName(say(lost, "target-not-published"))


def reconcile(asked: DataFrame, said: DataFrame, rulings: DataFrame) -> DataFrame:
    """route, key, verdict. asked: route, key; said: route, said; rulings: scope (route or null), key, ruling.

    Joined on the route first, then a key is looked for in its route's text alone. A ruling for the route precedes a general one.
    """
    from ..functions.text import says

    t = asked.distinct().join(said, "route").withColumn("hit", says(F.col("said"), F.col("key"))).drop("said")
    own = rulings.filter("scope is not null").select(F.col("scope").alias("route"), "key", F.col("ruling").alias("r1"))
    general = rulings.filter("scope is null").select("key", F.col("ruling").alias("r2"))
    t = t.join(own, ["route", "key"], "left").join(general, "key", "left").withColumn("ruling", F.coalesce("r1", "r2"))
    verdict = F.when(F.col("hit") & F.col("ruling").isNotNull(), "contradicted").when(F.col("hit"), "matched").when(F.col("ruling").isNotNull(), "ruled").otherwise("unpainted")
    return t.select("route", "key", verdict.alias("verdict"))


def _ruled(asked: DataFrame, rulings: DataFrame) -> DataFrame:
    """asked with used (the ruling found: scope and key) or null; a ruling for the route precedes a general one."""
    named = F.struct("scope", "key")
    own = rulings.filter("scope is not null").select(F.col("scope").alias("route"), "key", named.alias("u1"))
    general = rulings.filter("scope is null").select("key", named.alias("u2"))
    return asked.join(own, ["route", "key"], "left").join(general, "key", "left").withColumn("used", F.coalesce("u1", "u2")).drop("u1", "u2")


def account(live: DataFrame, ours: DataFrame, rulings: DataFrame) -> DataFrame:
    """route, key, side (live, ours), state: what each page of a pair asks against what the other says.

    live, ours: route, asked (array of keys), said; rulings: scope (route or null), key. A key is matched, contradicted (matched
    and ruled on), ruled, or else unpainted (live) or invented (ours). Texts stay with their route: only keys are exploded.
    """
    from ..functions.text import says

    pair = live.select("route", F.col("asked").alias("a1"), F.col("said").alias("s1")).join(ours.select("route", F.col("asked").alias("a2"), F.col("said").alias("s2")), "route")
    judged = lambda keys, said, side: F.transform(F.array_distinct(F.col(keys)), lambda k: F.struct(k.alias("key"), F.lit(side).alias("side"), says(F.col(said), k).alias("hit")))
    each = pair.select("route", F.explode(F.concat(judged("a1", "s2", "live"), judged("a2", "s1", "ours"))).alias("x")).select("route", "x.*")
    found = F.col("used").isNotNull()
    state = F.when(F.col("hit") & found, "contradicted").when(F.col("hit"), "matched").when(found, "ruled").when(F.col("side") == "live", "unpainted").otherwise("invented")
    return _ruled(each, rulings).select("route", "key", "side", state.alias("state"), "used")


def reconcile_problems(accounts: DataFrame, rulings: DataFrame) -> DataFrame:
    """kind, route, key: what :func:`account` could not settle, contradictions once a route and key, and rulings that no page asked for."""
    open_ = accounts.filter(F.col("state").isin("unpainted", "invented")).select(F.col("state").alias("kind"), "route", "key")
    both = accounts.filter("state = 'contradicted'").select(F.col("state").alias("kind"), "route", "key").distinct()
    used = accounts.filter("used is not null").select("used.*").distinct()
    stale = rulings.alias("r").join(used.alias("u"), F.col("r.scope").eqNullSafe(F.col("u.scope")) & (F.col("r.key") == F.col("u.key")), "left_anti")
    return open_.unionByName(both).unionByName(stale.select(F.lit("stale").alias("kind"), F.lit(None).cast("string").alias("route"), "key"))


def reconcile_routes(accounts: DataFrame) -> DataFrame:
    """route, live_asked, ours_asked, matched, ruled, ours_ruled: one row a reconciled route that asks anything."""
    n = lambda c, a: F.count_if(c).alias(a)
    live, hit = F.col("side") == "live", F.col("state").isin("matched", "contradicted")
    return accounts.groupBy("route").agg(n(live, "live_asked"), n(~live, "ours_asked"), n(live & hit, "matched"), n(live & (F.col("state") == "ruled"), "ruled"), n(~live & (F.col("state") == "ruled"), "ours_ruled"))


def provenance_findings(intended: DataFrame, claims: DataFrame) -> DataFrame:
    """code, id. intended: id, origin (null: not said), has_source, derived_by; claims: key of a source entity, by (a claiming id).

    An identity that several entries have is contested; an entry says its origin, carries no source entity in public, and names
    what derives it if and only if it is derived; a source entity with several claims is contested.
    """
    say = lambda d, code, c="id": d.select(F.lit(code).alias("code"), F.col(c).alias("id"))
    shared = intended.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    derived = F.col("origin") == "derived"
    faults = F.when(F.col("origin").isNull(), 1).otherwise(F.col("has_source").cast("int") + (derived & (F.coalesce("derived_by", F.lit("")) == "")).cast("int") + (~derived & F.col("derived_by").isNotNull()).cast("int"))
    missing = intended.select("id", F.explode(F.array_repeat(F.lit(1), faults)).alias("one"))
    contested = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return say(shared, "IDENTITY_CONTESTED").unionByName(say(missing, "PROVENANCE_MISSING")).unionByName(say(contested, "PROVENANCE_CONTESTED", "key"))


def lineage(intended: DataFrame, claims: DataFrame) -> DataFrame:
    """id, n_routes, routes, withheld: intended (id), claims (id, route)."""
    c = claims.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"), F.countDistinct("route").alias("n"))
    return intended.join(c, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_routes"), F.coalesce("routes", F.lit("")).alias("routes"), F.col("n").isNull().alias("withheld"))


def route_checks(promised: DataFrame, found: DataFrame) -> DataFrame:
    """code, file: promised (file) against found (file, bytes)."""
    a = promised.join(found, "file", "left_anti").select(F.lit("missing-file").alias("code"), "file")
    b = promised.join(found.filter("bytes = 0"), "file", "left_semi").select(F.lit("empty-file").alias("code"), "file")
    c = found.filter(F.col("file").endswith(".html")).join(promised, "file", "left_anti").select(F.lit("unclaimed-file").alias("code"), "file")
    return a.unionByName(b).unionByName(c)


def broken_links(refs: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, raw: internal page references none of whose candidates is a file. refs: page_id, tag, raw; files: file."""
    t = refs.filter((F.col("tag") == "a") & (U.scope_of(F.col("raw")) == "internal")).select("page_id", "raw").distinct()
    p = F.regexp_replace(U.path_part(F.col("raw")), "^/+|/+$", "")
    cand = F.array_distinct(F.array(F.when(p == "", "index.html").otherwise(F.concat(p, F.lit("/index.html"))), p, F.concat(p, F.lit(".html"))))
    each = t.withColumn("file", F.explode(cand))
    good = each.join(files.select("file").distinct(), "file", "left_semi").select("page_id", "raw").distinct()
    return t.join(good, ["page_id", "raw"], "left_anti")
