"""The audit of a finished build: what was promised, emitted, linked to and kept out of search, judged by one mask a path or file.

All claims on files and paths (promised, emitted, stub, published, data, linked, out of search) are one tagged union with a bit each. One
exchange by key ors the bits, and every rule is a predicate on the mask. A hot target, such as a link in every page's menu, is one row
after the map side. HTML is read once, in a projection that keeps facts; the facts are cut off and used by all rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import site as S
from ..functions import url as U
from .lineage import cut

PROMISED, EMITTED, STUB, PUBLISHED, DATA, LINKED, UNINDEXED = (1 << i for i in range(7))

# The mark of the preview notice, language tags that a registry accepts, keys that would publish the source's ids,
# phrases that speak of a build, artifacts that a build must have.
NOTICE = "data-wpk-scope-notice"
LANGUAGE = "^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"
SOURCE_KEYS = ("sourceId", "source_id", "wpId", "wordpressId", "termId", "postId")
PHRASES = ("this preview", "this build", "staging site", "coming soon", "sample content")
ARTIFACTS = ("_redirects", "redirects.json")


@dataclass(frozen=True)
class Site:
    """What a build is audited for. migrated: hosts whose uploads were to move here."""

    environment: str = "preview"
    origin: str | None = None
    migrated: tuple[str, ...] = ()
    uploads: str = "wp-content/uploads"


def facts(emitted: DataFrame, site: Site) -> DataFrame:
    """file, h1, title, lang, main, robots, notice, links (struct(target, key)), insecure, stale, phrases of HTML files. emitted: file, text."""
    html = F.col("text")
    refs = F.filter(H.references(html), lambda r: ~r["kind"].isin("css", "markdown"))
    targets = F.filter(H.link_references(html), lambda r: (r["attribute"] == "href") & (U.scope_of(r["raw"]) == "internal"))
    links = F.transform(targets, lambda r: F.struct(U.path_part(r["raw"]).alias("target"), U.trim_slashes(U.path_part(r["raw"])).alias("key")))
    host = lambda u: U.host_key(F.regexp_extract(u, "(?i)^(?:https?:)?//([^/?#]*)", 1))
    own = lambda u: (host(u) == "") | host(u).isin(*[h.lower().removeprefix("www.") for h in site.migrated] or [""])
    stale = F.filter(F.transform(refs, lambda r: r["url"]), lambda u: u.contains(f"/{site.uploads.strip('/')}/") & own(u)) if site.migrated else F.array().cast("array<string>")
    text = F.lower(F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", ""), "<[^>]+>", " "))
    return emitted.filter(F.col("file").endswith(".html")).select(
        "file", F.size(H.all_of(html, "(?i)(<h1)\\b")).alias("h1"), (F.coalesce(H.title_of(html), F.lit("")) != "").alias("title"), F.coalesce(H.html_lang(html).rlike(LANGUAGE), F.lit(False)).alias("lang"),
        html.rlike("""(?i)<main\\b[^>]*\\bid=["']main["']""").alias("main"), H.meta(html, "robots").alias("robots"), html.contains(NOTICE).alias("notice"), F.array_distinct(links).alias("links"),
        F.array_distinct(F.transform(F.filter(refs, lambda r: r["kind"].isin("src", "srcset", "lazy") & r["url"].startswith("http://")), lambda r: r["url"])).alias("insecure"),
        F.array_distinct(stale).alias("stale"), F.array_compact(F.array(*[F.when(text.contains(p), p) for p in PHRASES])).alias("phrases"),
    )


def masks(inventory: DataFrame, emitted: DataFrame, linked: DataFrame, redirects: DataFrame, overrides: DataFrame) -> DataFrame:
    """space (file or path), key, mask, stub (a rule's source), asked (an override's path). linked: key."""
    claim = lambda d, space, key, bit, stub=None, asked=None: d.select(F.lit(space).alias("space"), key.alias("key"), (bit if isinstance(bit, Column) else F.lit(bit)).alias("bit"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("stub", stub), ("asked", asked))])
    key = U.trim_slashes(F.col("path"))
    parts = [
        claim(inventory, "file", F.col("file"), PROMISED), claim(inventory, "path", key, F.when(F.col("kind") == "data", DATA).otherwise(PUBLISHED)), claim(emitted, "file", F.col("file"), EMITTED),
        claim(redirects, "file", U.page_file(F.col("from_path")), STUB, stub=F.col("from_path")), claim(linked, "path", F.col("key"), LINKED), claim(overrides.filter("noindex"), "path", key, UNINDEXED, asked=F.col("path")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("space", "key").agg(F.bit_or("bit").alias("mask"), F.min("stub").alias("stub"), F.min("asked").alias("asked"))


def _mask_findings(masked: DataFrame, site: Site) -> DataFrame:
    has = lambda bits: F.col("mask").bitwiseAND(F.lit(bits)) != 0
    say = lambda code, at, detail=F.lit(""): F.struct(F.lit(code).alias("code"), at.alias("at"), detail.alias("detail"))
    file = F.col("space") == "file"
    found = F.array_compact(F.array(
        F.when(file & has(PROMISED) & ~has(EMITTED), say("missing-file", F.col("key"))),
        F.when(file & has(EMITTED) & ~has(PROMISED) & F.col("key").endswith(".html"), say("unclaimed-file", F.col("key"))),
        F.when(file & has(STUB) & ~has(EMITTED), say("missing-stub", F.col("key"), F.col("stub"))),
        F.when(~file & has(UNINDEXED) & (S.robots_directive(F.col("key"), F.lit(site.environment)) != "noindex"), say("indexed-against-source", F.col("asked"))),
    ))
    return masked.select(F.explode(found).alias("f")).select("f.*")


def path_findings(inventory: DataFrame, emitted: DataFrame, redirects: DataFrame, overrides: DataFrame, site: Site, known: DataFrame | None = None) -> DataFrame:
    """code, at, detail of the six kinds that join paths: missing-file, unclaimed-file, missing-stub, indexed-against-source, dead-link (page,
    target) and stale-upload (file, reference). A link reaches a published or data path or names a file.

    inventory: path, file, kind; emitted: file, text; redirects: from_path; overrides: path, noindex.
    """
    known = cut(facts(emitted, site)) if known is None else known
    pages = inventory.filter("kind = 'page'").select("path", "file")
    links = pages.join(known.select("file", "links"), "file").select("path", F.explode("links").alias("l")).select("path", "l.target", "l.key")
    masked = masks(inventory, emitted, links.select("key"), redirects, overrides)
    lost = masked.filter((F.col("space") == "path") & (F.col("mask").bitwiseAND(F.lit(LINKED)) != 0) & (F.col("mask").bitwiseAND(F.lit(PUBLISHED | DATA)) == 0) & ~F.col("key").rlike("(?i)\\.[a-z0-9]{2,5}$")).select("key")
    dead = links.join(lost, "key", "left_semi").select(F.lit("dead-link").alias("code"), F.col("path").alias("at"), F.col("target").alias("detail")).distinct()
    stale = known.select(F.lit("stale-upload").alias("code"), F.col("file").alias("at"), F.explode("stale").alias("detail"))
    return _mask_findings(masked, site).unionByName(dead).unionByName(stale)


def _page_findings(inventory: DataFrame, known: DataFrame, site: Site) -> DataFrame:
    """What a page's own head and media break."""
    want = S.robots_directive(F.col("path"), F.lit(site.environment))
    preview = site.environment != S.PRODUCTION
    say = lambda code, detail=F.lit(""): F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    own = F.array_compact(F.array(
        F.when(F.col("h1") != 1, say("h1-count", F.col("h1"))), F.when(~F.col("title"), say("no-title")), F.when(~F.col("lang"), say("no-lang")), F.when(~F.col("main"), say("no-main")),
        F.when(~F.col("robots").eqNullSafe(want), say("wrong-robots", F.coalesce("robots", F.lit("")))), F.when(F.col("notice") != F.lit(preview), say("no-scope-notice" if preview else "scope-notice")),
    ))
    every = F.concat(own, F.transform("insecure", lambda u: say("insecure-media", u)))
    t = inventory.filter("kind = 'page'").select("path", "file").join(known.drop("links", "stale", "phrases"), "file")
    return t.select(F.col("path").alias("at"), F.explode(every).alias("f")).select("f.code", "at", "f.detail")


def _artifact_findings(inventory: DataFrame, emitted: DataFrame, site: Site) -> DataFrame:
    """What robots.txt, sitemap.xml, the manifest and the redirect artifacts break. One row a file."""
    preview, text = site.environment != S.PRODUCTION, F.col("text")
    closed = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s*\n\s*", -1) == F.array(F.lit("User-agent: *"), F.lit("Disallow: /"))
    locs = F.size(F.split(text, F.lit("<loc>"), -1)) - 1
    listed = inventory.filter("kind = 'page'").agg(F.count_if(S.sitemap_disposition(F.col("path"), F.lit(site.environment)) == "included").alias("expected"))
    t = emitted.filter(F.col("file").isin("robots.txt", "sitemap.xml", "deployment.json")).crossJoin(F.broadcast(listed))  # one row
    expected = F.col("expected") if site.origin else F.lit(0)
    wrong_robots = ~closed if preview else ~text.contains("Allow: /")
    leaks = F.filter(F.array(*[F.lit(k) for k in SOURCE_KEYS]), lambda k: F.regexp_like(text, F.concat(F.lit('"'), k, F.lit('"\\s*:'))))
    say = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    found = (
        F.when((F.col("file") == "robots.txt") & wrong_robots, F.array(say("wrong-robots-txt", F.lit(""))))
        .when((F.col("file") == "sitemap.xml") & (locs != expected), F.array(say("sitemap-count", F.concat_ws(" of ", locs.cast("string"), expected.cast("string")))))
        .when(F.col("file") == "deployment.json", F.transform(leaks, lambda k: say("source-id-served", k)))
    )
    spark = inventory.sparkSession
    asked = spark.createDataFrame([(x,) for x in (*ARTIFACTS, "robots.txt", "sitemap.xml", "deployment.json")], "file string")
    gone = asked.join(emitted.select("file"), "file", "left_anti").select(F.lit("missing-artifact").alias("code"), F.col("file").alias("at"), F.lit("").alias("detail"))
    return t.select(F.col("file").alias("at"), F.explode(found).alias("f")).select("f.code", "at", "f.detail").unionByName(gone)


def audit(inventory: DataFrame, emitted: DataFrame, redirects: DataFrame, overrides: DataFrame, samples: DataFrame, site: Site) -> DataFrame:
    """code, at, detail: every finding of a build. samples: id of content that is not the site's own, refused in production only.

    Null texts are files without content. Files in several rows, repeated routes and rules give one finding each.
    """
    known = cut(facts(emitted, site))
    out = path_findings(inventory, emitted, redirects, overrides, site, known).unionByName(_page_findings(inventory, known, site)).unionByName(_artifact_findings(inventory, emitted, site))
    if site.environment == S.PRODUCTION:
        out = out.unionByName(samples.select(F.lit("sample-content").alias("code"), F.col("id").alias("at"), F.lit("").alias("detail")))
    return out


def phrase_notes(inventory: DataFrame, emitted: DataFrame) -> DataFrame:
    """phrase, pages: words on pages that may speak of the build instead of the site; to be read, not refused."""
    known = facts(emitted, Site()).select("file", "phrases")
    pages = inventory.filter("kind = 'page'").select("path", "file").distinct()
    return pages.join(known, "file").select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("pages"))


def verdict(findings: DataFrame) -> int:
    """The exit of a gate: 0 for a clean build, 1 for one with findings. Only a flag reaches the driver."""
    return 0 if findings.isEmpty() else 1
