"""A bounded crawl over stored responses: robots, sitemaps and their indexes, then waves of links, under one budget of requests.

The frontier is a table. A wave is cut to what the budget allows by a prefix sum over the order of arrival, so a crawl of any width stops at
the same place as one that reads URL by URL. What was attempted and what was read are kept apart: a sitemap that answers with an error
page, or with a page that holds no location, was not read. All ways by which a key was found are rows of their own (a front page has as
many as there are pages), never one list. Bodies are read once, for their links and locations; joins move keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..sources import structured as X
from .lineage import cut
from .ordering import numbered, running_total

# Where sitemaps lie that no robots.txt names, and answers that refuse.
FALLBACKS = ("/wp-sitemap.xml", "/sitemap.xml")
REFUSED = (403, 429)


@dataclass(frozen=True)
class Crawl:
    """records: key, url, family, position, wave, fetched, status, location, content_type, canonical, skipped, n_sources; sources: key, source,
    position; notes: code, at, detail; requests made."""

    records: DataFrame
    sources: DataFrame
    notes: DataFrame
    requests: int


def responses(site: DataFrame, origin: str) -> DataFrame:
    """What a crawl needs of stored responses (url, status, content_type, location, body): keys, links and locations instead of bodies."""
    body, o = F.col("body"), F.lit(origin)
    html = body.isNotNull() & F.coalesce(F.lower("content_type"), F.lit("")).contains("text/html")
    links = F.transform(F.filter(H.link_references(body), lambda r: (r["tag"] == "a") & (r["attribute"] == "href")), lambda r: H.let(U.resolve(r["raw"], o), lambda u: U.comparison_key(u, o)))
    return site.select(
        "url", U.comparison_key(F.col("url"), o).alias("key"), "status", "content_type", "location", body.isNotNull().alias("has_body"), F.when(html, F.get(H.canonicals(body), F.lit(0))).alias("canonical"),
        F.when(html, F.array_compact(links)).alias("links"), X.is_sitemap_index(body).alias("is_index"), F.when(body.isNotNull(), X.sitemap_urls(body)).alias("locs"),
        F.when(F.col("url") == f"{origin}/robots.txt", X.robots_sitemaps(body)).alias("robots"),
    )


def _notes(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "code string, at string, detail string")


def read_sitemaps(read: DataFrame, seeds: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, int]:
    """(attempted: url, round, rank, status, state; arrivals: key, source, a, b, c; requests). seeds: url, b, c (their order).

    state is index, read, refused-status, no-body or no-locations. Every round reads what the indexes of the last one name, whatever their depth; a
    document is attempted once.
    """
    spark = read.sparkSession
    attempted = arrivals = None
    frontier, used, n = seeds, 0, 0
    while True:
        new = frontier.groupBy("url").agg(F.min(F.struct("b", "c")).alias("o")).select("url", "o.b", "o.c")
        if attempted is not None:
            new = new.join(attempted.select("url"), "url", "left_anti")
        ranked = numbered(new, ["b", "c"], "rank").filter(F.col("rank") < budget - used)
        status = F.coalesce("status", F.lit(0))
        state = F.when(status != 200, "refused-status").when(~F.coalesce("has_body", F.lit(False)), "no-body").when(F.col("is_index"), "index").when(F.size("locs") == 0, "no-locations").otherwise("read")
        got = cut(ranked.join(read.select("url", "status", "has_body", "is_index", "locs"), "url", "left").select("url", F.lit(n).alias("round"), "rank", status.alias("status"), state.alias("state"), "locs"))
        made = got.count()
        if not made:
            break
        used += made
        rows = got.drop("locs")
        attempted = rows if attempted is None else attempted.unionByName(rows)
        here = got.filter("state = 'read'").select("url", "rank", F.posexplode("locs").alias("c", "loc"))
        here = here.select("loc", F.concat(F.lit("sitemap:"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("source"), F.lit(n).alias("a"), F.col("rank").alias("b"), F.col("c").cast("long").alias("c"))
        arrivals = here if arrivals is None else arrivals.unionByName(here)
        frontier = got.filter("state = 'index'").select(F.col("rank").alias("b"), F.posexplode("locs").alias("c", "url")).select("url", "b", F.col("c").cast("long").alias("c"))
        n += 1
    empty = spark.createDataFrame([], "loc string, source string, a int, b long, c long")
    return (attempted if attempted is not None else spark.createDataFrame([], "url string, round int, rank long, status int, state string")), (arrivals if arrivals is not None else empty), used


def crawl(site: DataFrame, origin: str, links: U.Permalinks = U.Permalinks(), waves: int = 2, max_requests: int = 2000) -> Crawl:
    """Records, their sources and notes of a crawl of a stored site (url, status, content_type, location, body).

    A URL that the site does not hold answers 0. The last wave reads but adds nothing. Records that a rule skips take no request; when the
    budget is spent, neither what comes later in the order nor a further wave is looked at.
    """
    spark = site.sparkSession
    read = cut(responses(site, origin))
    notes: list[tuple] = []
    robots = read.filter(F.col("url") == f"{origin}/robots.txt").select("status", F.size("robots").alias("n")).first()
    if robots and robots["status"] in REFUSED:
        notes.append(("robots-refused", f"{origin}/robots.txt", str(robots["status"])))
    if robots and (robots["n"] or 0) > 0:
        seeds = read.filter(F.col("url") == f"{origin}/robots.txt").select(F.posexplode("robots").alias("c", "url")).select("url", F.lit(0).cast("long").alias("b"), F.col("c").cast("long").alias("c"))
    else:
        notes.append(("no-sitemap-advertised", f"{origin}/robots.txt", str(robots["status"] if robots else 0)))
        seeds = spark.createDataFrame([(f"{origin}{p}", 0, i) for i, p in enumerate(FALLBACKS)], "url string, b long, c long")
    attempted, found, used = read_sitemaps(read, seeds, max_requests - 1)
    requests = used + 1
    failed = attempted.filter("state in ('refused-status', 'no-body', 'no-locations')").select(F.concat(F.lit("sitemap-"), "state").alias("code"), F.col("url").alias("at"), F.col("status").cast("string").alias("detail"))
    sums = attempted.agg(F.count_if(F.col("state").isin("read", "index")).alias("read"), F.count(F.lit(1)).alias("all")).first()
    notes.append(("sitemaps-read", "", f"{sums['read']} of {sums['all']}"))
    if not sums["read"]:
        notes.append(("no-sitemap-read", "", ""))

    o = F.lit(origin)
    arrived = found.select(U.comparison_key(U.resolve(F.col("loc"), o), o).alias("key"), "source", "a", "b", "c").filter("key is not null")
    arrived = arrived.unionByName(spark.createDataFrame([("/", "seed", 1 << 30, 0, 0)], "key string, source string, a int, b long, c long"))
    ways = [cut(arrived.groupBy("key", "source").agg(F.min(F.struct("a", "b", "c")).alias("o")).withColumn("wave", F.lit(-1)))]
    by_key = read.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("url") != F.concat(o, "key"), "url")).alias("x")).select(F.col("x.url").alias("url"))
    pages = cut(read.join(by_key, "url").select("key", "status", "location", "content_type", "canonical", "links"))

    done: list[DataFrame] = []
    seen: DataFrame | None = None
    stopped, held = False, 0
    for wave in range(waves + 1):
        new = ways[-1].groupBy("key").agg(F.min("o").alias("o"))
        if seen is not None:
            new = new.join(seen, "key", "left_anti")
        new = new.select("key", "o.a", "o.b", "o.c", U.skip_reason(F.col("key"), links.languages).alias("skip"))
        reached = running_total(new, ["a", "b", "c", "key"], F.col("skip").isNull(), "before").withColumn("on", F.col("before") + requests < max_requests)
        here = numbered(reached, ["a", "b", "c", "key"], "rank")
        asks = F.col("on") & F.col("skip").isNull()
        got = here.join(pages, "key", "left").select(
            "key", F.lit(wave).alias("wave"), (F.col("rank") + held).alias("position"), asks.alias("fetched"), F.when(asks, F.coalesce("status", F.lit(0))).alias("status"), *[F.when(asks, F.col(c)).alias(c) for c in ("location", "content_type", "canonical")],
            F.when(F.col("on"), F.col("skip")).alias("skipped"), F.when(asks, F.col("links")).alias("links"), "on",
        )
        got = cut(got)
        sums = got.agg(F.count(F.lit(1)).alias("n"), F.count_if("fetched").alias("fetched"), F.count_if(~F.col("on")).alias("left")).first()
        if not sums["n"]:
            break
        requests, held = requests + sums["fetched"], held + sums["n"]
        done.append(got.drop("links", "on"))
        seen = got.select("key") if seen is None else seen.unionByName(got.select("key"))
        stopped = sums["left"] > 0
        # links that the last wave reads are not followed, nor noted as sources
        if wave < waves:
            linked = got.filter("fetched").select("key", "position", F.posexplode("links").alias("c", "to"))
            ways.append(cut(linked.groupBy(F.col("to").alias("key"), F.concat(F.lit("link:"), "key").alias("source")).agg(F.min(F.struct(F.lit(wave).alias("a"), F.col("position").alias("b"), F.col("c").cast("long").alias("c"))).alias("o")).withColumn("wave", F.lit(wave))))
        if stopped:
            break
        if wave == waves:
            break
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    after = None if seen is None or len(ways) <= len(done) else ways[-1].groupBy("key").agg(F.min("o").alias("o")).join(seen, "key", "left_anti")
    if after is not None:  # found, but the budget ended before they could be looked at
        late = numbered(after.select("key", "o.a", "o.b", "o.c"), ["a", "b", "c", "key"], "rank")
        blank = {c: F.lit(None).cast(k) for c, k in (("status", "int"), ("location", "string"), ("content_type", "string"), ("canonical", "string"), ("skipped", "string"))}
        every = every.unionByName(late.select("key", F.lit(len(done)).alias("wave"), (F.col("rank") + held).alias("position"), F.lit(False).alias("fetched"), *[v.alias(c) for c, v in blank.items()]))
    whole = ways[0]
    for w in ways[1:]:
        whole = whole.unionByName(w)
    sources = whole.groupBy("key", "source").agg(F.min(F.struct("wave", "o")).alias("position"))
    counts = sources.groupBy("key").agg(F.count(F.lit(1)).alias("n_sources"))
    records = cut(every.join(counts, "key").select("key", F.concat(o, "key").alias("url"), U.classify_family(F.col("key"), links).alias("family"), "position", "wave", "fetched", "status", "location", "content_type", "canonical", "skipped", "n_sources"))
    open_ = records.agg(F.count_if(~F.col("fetched")).alias("unread"), F.count_if(~F.col("fetched") & F.col("skipped").isNull()).alias("left")).first()
    if stopped:
        notes.append(("stopped-at-bound", str(max_requests), str(open_["unread"])))
    if open_["left"]:
        notes.append(("unfetched", "", str(open_["left"])))
    return Crawl(records, sources.select("key", "source", "position"), failed.unionByName(_notes(spark, notes)), requests)
