"""Artifacts: global order, bounded files, duplicates and failed tasks leave what was there."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import artifacts as A

ORIGIN = "https://new.example"


def pages(spark, n, dup=False):
    t = spark.range(n).select(F.concat(F.lit("/p"), F.lpad("id", 4, "0"), F.lit("/?a&b")).alias("path"), F.when(F.col("id") % 2 == 0, "2026-01-02").alias("lastmod"))
    return t.unionByName(t.limit(1)) if dup else t


def read(folder):
    return {f: open(f"{folder}/{f}").read() for f in os.listdir(folder) if os.path.isfile(f"{folder}/{f}")}


def test_files_are_bounded_and_follow_each_other(spark, tmp_path):
    form = A.sitemap_form(ORIGIN, limit=7)
    A.publish(A.sitemap_rows(pages(spark, 40), ORIGIN).orderBy(F.rand(3)), str(tmp_path), form, 3)
    got = read(tmp_path)
    names = re.findall(f"<loc>{ORIGIN}/(.*?)</loc>", got["sitemap.xml"])
    assert "<sitemapindex" in got["sitemap.xml"] and names == [f"sitemap-{i}.xml" for i in range(1, len(names) + 1)] and set(names) | {"sitemap.xml"} == set(got)
    locs = [x for n in names for x in re.findall("<loc>(.*?)</loc>", got[n])]
    assert locs == [f"{ORIGIN}/p{i:04d}/?a&amp;b" for i in range(40)] and all(1 <= got[n].count("<url>") <= 7 and got[n].startswith("<?xml") and got[n].endswith("</urlset>\n") for n in names)
    assert sum(got[n].count("<lastmod>") for n in names) == 20


def test_one_file_is_the_artifact_itself(spark, tmp_path):
    A.publish(A.sitemap_rows(pages(spark, 3), ORIGIN), str(tmp_path), A.sitemap_form(ORIGIN), 1)
    assert list(read(tmp_path)) == ["sitemap.xml"] and read(tmp_path)["sitemap.xml"].count("<url>") == 3
    A.publish(A.sitemap_rows(pages(spark, 40), ORIGIN), str(tmp_path), A.sitemap_form(ORIGIN, 10), 2)
    assert len(read(tmp_path)) > 3
    A.publish(A.sitemap_rows(pages(spark, 0), ORIGIN), str(tmp_path), A.sitemap_form(ORIGIN), 2)
    assert {k: v.count("<url>") for k, v in read(tmp_path).items()} == {"sitemap.xml": 0} and [f for f in os.listdir(tmp_path)] == ["sitemap.xml"]


def test_a_key_claimed_twice_aborts(spark, tmp_path):
    form = A.sitemap_form(ORIGIN, 7)
    A.publish(A.sitemap_rows(pages(spark, 9), ORIGIN), str(tmp_path), form, 2)
    before = read(tmp_path)
    with pytest.raises(Exception, match="claimed twice, as /p0000/"):
        A.publish(A.sitemap_rows(pages(spark, 30, dup=True), ORIGIN), str(tmp_path), form, 2)
    assert read(tmp_path) == before and not [f for f in os.listdir(tmp_path) if f.startswith(".staging")]


def test_a_failed_task_leaves_no_half_artifact(spark, tmp_path):
    form = A.manifest_form("preview", 5)
    rows = spark.range(30).select(F.concat(F.lit("/"), F.lpad("id", 3, "0")).alias("path"), F.lit("f").alias("file"), F.lit("page").alias("kind"), F.lit("x").alias("origin"))
    A.publish(A.manifest_rows(rows.filter("id < 3") if "id" in rows.columns else rows.limit(3)), str(tmp_path), form, 1)
    before = read(tmp_path)

    @F.udf("string")
    def breaks(line):
        if '"/029"' in line:
            raise RuntimeError("lost")
        return line

    with pytest.raises(Exception, match="lost"):
        A.publish(A.manifest_rows(rows).withColumn("line", breaks("line")), str(tmp_path), form, 3)
    assert read(tmp_path) == before and not [f for f in os.listdir(tmp_path) if f.startswith(".staging")]
    with pytest.raises(Exception, match="null"):
        A.publish(rows.select(F.lit(None).cast("string").alias("key"), F.lit("x").alias("line")), str(tmp_path), form, 1)
    assert read(tmp_path) == before


def test_json_artifacts_are_json(spark, tmp_path):
    docs = spark.createDataFrame([(f"posts/{c}@en", "post", 'T "q"', None, f"/{c}/", ["x"], []) for c in "cab"], "id string, kind string, title string, summary string, url string, categories array<string>, tags array<string>")
    A.publish(A.search_rows(docs), str(tmp_path), A.search_form("en"), 1)
    got = json.loads(read(tmp_path)["search-index.en.json"])
    assert got["version"] == 1 and got["locale"] == "en" and [d["id"] for d in got["documents"]] == ["posts/a@en", "posts/b@en", "posts/c@en"] and got["documents"][0]["title"] == 'T "q"' and got["documents"][0]["summary"] is None
    A.publish(A.search_rows(docs), str(tmp_path), A.search_form("fr", 1), 2)
    got = read(tmp_path)
    index = json.loads(got["search-index.fr.json"])
    assert index["count"] == 3 and [json.loads(got[f])["documents"][0]["id"] for f in index["files"]] == ["posts/a@en", "posts/b@en", "posts/c@en"] and "search-index.en.json" in got


def test_overrides_leave_out_silent_pages_and_refuse_others(spark, tmp_path):
    t = spark.createDataFrame([("/b/", "en", "B", None, None, True, None), ("/a/", "en", None, "d", None, None, None), ("/s/", "en", None, None, None, False, None), ("/r/", "en", "x", None, None, None, "two titles")], "path string, locale string, title string, description string, canonical string, noindex boolean, problem string")
    rows, silent, refused = A.overrides(t)
    A.publish(rows, str(tmp_path), A.overrides_form(), 1)
    assert json.loads(read(tmp_path)["overrides.json"]) == [{"path": "/a/", "locale": "en", "description": "d"}, {"path": "/b/", "locale": "en", "title": "B", "robots": {"noindex": True}}]
    assert [tuple(r) for r in silent.collect()] == [("/s/",)] and [tuple(r) for r in refused.collect()] == [("/r/", "two titles")]


def test_difference_report(spark, tmp_path):
    t = spark.createDataFrame([("/b/", "GAP", None), ("/a/", "GAP", None), ("/c/", "REDIRECT", "/x/")], "key string, classification string, redirect_target string")
    A.publish(A.diff_report_rows(t), str(tmp_path), A.diff_report_form("2026-01-01"), 1)
    assert read(tmp_path)["diff-report.md"] == "# Inventory difference, 2026-01-01\n\n## GAP (2)\n- `/a/`\n- `/b/`\n## REDIRECT (1)\n- `/c/` → `/x/`\n"


def test_dated_evidence(spark, tmp_path):
    t = spark.createDataFrame([("/b/", 200, None), ("/a/", None, "x")], "key string, status int, `a b` string")
    for day in ("2026-01-01", "2026-02-01", "2026-01-01"):
        A.evidence(t, str(tmp_path), "site-map", day, "key", {"origin": ORIGIN, "startedAt": day})
    assert sorted(os.listdir(tmp_path)) == ["site-map-2026-01-01", "site-map-2026-02-01"]
    got = [json.loads(x) for d in sorted(os.listdir(tmp_path)) for x in read(tmp_path / d).values()]
    whole = [r for g in got for r in (g["records"] if "records" in g and g["records"] else [])]
    assert all(g["origin"] == ORIGIN for g in got) and {(r["key"], r["status"], r["a b"]) for r in whole} == {("/a/", None, "x"), ("/b/", 200, None)}


def test_which_file_a_row_falls_into(spark):
    got = [(r["file"], r["pos"]) for r in A.sharded(A.sitemap_rows(pages(spark, 10), ORIGIN), A.sitemap_form(ORIGIN, 4)).orderBy("key").collect()]
    assert got == [(i // 4 + 1, i % 4) for i in range(10)]
