"""The bounded crawl against one that reads URL by URL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import url as U
from quarrymill.operators import crawl as W
from quarrymill.operators.ordering import numbered, running_total

O = "https://site.example"
SCHEMA = "url string, status int, content_type string, location string, body string"
SKIP = {"png": "media-asset"}


def key_of(url):
    if url.startswith("/"):
        url = O + url
    if not url.startswith(O):
        return None
    rest = url[len(O) :].split("#")[0] or "/"
    path, q, query = rest.partition("?")
    return (path if path.endswith("/") or "." in path.rsplit("/", 1)[-1] else path + "/") + (q + query if query else "")


def skip_of(key):
    return "query-variant" if "?" in key else "media-asset" if key.endswith(".png") else None


def by_hand(site, waves, most):
    """(records {key: (position, fetched, status, skipped)}, sources, requests): one URL after the other."""
    requests, attempted, records, sources = 1, [], {}, []

    def note(url, source):
        key = key_of(url)
        if key is None:
            return
        records.setdefault(key, {"position": len(records), "fetched": False, "status": None, "skipped": None})
        if (key, source) not in sources:
            sources.append((key, source))

    robots = site.get(O + "/robots.txt")
    queue = re.findall(r"Sitemap: (\S+)", robots[1]) if robots else []
    queue = queue or [O + p for p in W.FALLBACKS]
    while queue and requests < most:
        url = queue.pop(0)
        if url in attempted:
            continue
        attempted.append(url)
        requests += 1
        status, body = site.get(url, (0, None))
        if status != 200 or body is None:
            continue
        locs = re.findall("<loc>(.*?)</loc>", body)
        if "<sitemapindex" in body:
            queue += locs
        else:
            for loc in locs:
                note(loc, "sitemap:" + url[len(O) :])
    note(O + "/", "seed")
    by_key = {key_of(u): v for u, v in sorted(site.items(), reverse=True)}
    stopped = False
    for wave in range(waves + 1):
        pending = [k for k, r in records.items() if not r["fetched"] and r["skipped"] is None]
        if not pending or stopped:
            break
        for key in pending:
            if requests >= most:
                stopped = True
                break
            r = records[key]
            if skip_of(key):
                r["skipped"] = skip_of(key)
                continue
            requests += 1
            status, body = by_key.get(key, (0, None))
            r["fetched"], r["status"] = True, status
            if body is not None and wave < waves:
                for href in re.findall('<a href="(.*?)"', body):
                    note(href, "link:" + key)
    return {k: tuple(r.values()) for k, r in records.items()}, sorted(sources), requests


def site_of(seed):
    r = random.Random(seed)
    paths = [f"/p{i}/" for i in range(40)] + ["/a.png", "/p1/?x=1"]
    link = lambda: f'<a href="{r.choice([p if r.random() < 0.7 else O + p for p in paths] + ["https://else.example/", "/p2/#top", "/gone/"])}">x</a>'
    site = {O + p: (r.choice([200, 200, 200, 404]), "".join(link() for _ in range(r.randrange(6)))) for p in ["/", *paths[:30]]}
    maps = [f"{O}/map{i}.xml" for i in range(6)]
    site[O + "/robots.txt"] = (200, "User-agent: *\n" + "".join(f"Sitemap: {m}\n" for m in r.sample(maps, 3)))
    for i, m in enumerate(maps):
        locs = "".join(f"<loc>{O}{p}</loc>" for p in r.sample(paths, 4))
        inner = "".join(f"<loc>{x}</loc>" for x in r.sample(maps, 3))
        site[m] = r.choice([(200, f"<urlset>{locs}</urlset>"), (200, f"<sitemapindex>{inner}</sitemapindex>"), (404, "<p>gone</p>"), (200, "<p>soft</p>")] if i else [(200, f"<urlset>{locs}</urlset>")])
    return site


def run(spark, site, waves, most):
    rows = [(u, s, "application/xml" if u.endswith("xml") else "text/html; charset=utf-8", None, b) for u, (s, b) in site.items()]
    return W.crawl(spark.createDataFrame(rows, SCHEMA), O, waves=waves, max_requests=most)


@pytest.mark.parametrize(("seed", "waves", "most"), [(1, 2, 2000), (2, 2, 17), (3, 3, 30), (4, 1, 6), (5, 0, 2000), (6, 4, 2)])
def test_crawl_reads_as_one_by_one(spark, seed, waves, most):
    site = site_of(seed)
    got = run(spark, site, waves, most)
    want, sources, requests = by_hand(site, waves, most)
    assert {r["key"]: (r["position"], r["fetched"], r["status"], r["skipped"]) for r in got.records.collect()} == want
    assert sorted((r["key"], r["source"]) for r in got.sources.collect()) == sources
    assert got.requests == requests
    assert ("stopped-at-bound" in {r["code"] for r in got.notes.collect()}) == (requests >= most)


def test_what_was_attempted_is_not_what_was_read(spark):
    site = {O + "/robots.txt": (200, f"Sitemap: {O}/sitemap_index.xml\nSitemap: {O}/soft.xml"), O + "/sitemap_index.xml": (404, "<html>not here</html>"), O + "/soft.xml": (200, "<html>error</html>"), O + "/": (200, "")}
    notes = {(r["code"], r["at"], r["detail"]) for r in run(spark, site, 2, 100).notes.collect()}
    assert notes == {("sitemap-refused-status", f"{O}/sitemap_index.xml", "404"), ("sitemap-no-locations", f"{O}/soft.xml", "200"), ("sitemaps-read", "", "0 of 2"), ("no-sitemap-read", "", "")}


def test_without_robots_the_fallbacks_are_tried(spark):
    got = run(spark, {O + "/sitemap.xml": (200, f"<urlset><loc>{O}/a/</loc></urlset>"), O + "/a/": (200, "")}, 0, 100)
    assert {r["key"]: r["status"] for r in got.records.collect()} == {"/a/": 200, "/": 0}
    assert ("no-sitemap-advertised", f"{O}/robots.txt", "0") in {tuple(r) for r in got.notes.collect()} and got.requests == 5


def test_resolved_references(spark):
    refs = ["/a/../b", "c/./d?x=../y", "//h.example/p", "https://x.example/a/b/../../../c/", "#top", "?q=1", "..", "mailto:x@y", "/a/..", "/plain"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in refs], "r string").select(U.resolve(F.col("r"), F.lit(O))).collect()]
    assert got == [f"{O}/b", f"{O}/c/d?x=../y", "https://h.example/p", "https://x.example/c/", f"{O}/#top", f"{O}/?q=1", f"{O}/", "mailto:x@y", f"{O}/", f"{O}/plain"]
    out = spark.createDataFrame([("a/../../b",), ("a/b/../c",), ("",)], "r string").select(U.normal_path(F.col("r")).alias("n")).collect()
    assert [tuple(r["n"]) for r in out] == [("b", True), ("a/c", False), ("", False)]


def test_running_totals(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows = sorted((r["k"], r["id"]) for r in df.collect())
    got = {r["id"]: (r["t"], r["n"]) for r in numbered(running_total(df, ["k"], F.col("id") % 7, "t"), ["k"], "n").collect()}
    total = 0
    for n, (_, i) in enumerate(rows):
        assert got[i] == (total, n)
        total += i % 7


def test_a_link_is_resolved_once(spark, capsys):
    from quarrymill.operators import crawl

    site = spark.createDataFrame([("https://a.example/", 200, "text/html", None, "<a href='/b/'>b</a>")], "url string, status int, content_type string, location string, body string")
    once = "^[A-Za-z][A-Za-z0-9+.-]*:"
    spark.range(1).select(crawl.U.resolve(crawl.F.lit("/b"), crawl.F.rand().cast("string"))).explain(True)
    own = capsys.readouterr().out.split("== Optimized Logical Plan ==")[0].split("== Analyzed Logical Plan ==")[1].count(once)
    crawl.responses(site, "https://a.example").select("links").explain(True)
    assert 0 < capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0].count(once) <= own
