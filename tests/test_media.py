"""Media of a content tree: what is found, what is planned, what is missing."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.url import MediaProfile
from quarrymill.operators import media as M

PROFILE = MediaProfile(hosts=("source.example", "mirror.example"), extra=("downloads",))
UP = "/wp-content/uploads/2026/01/"


def files(spark, **named):
    return spark.createDataFrame(list(named.items()) or [], "file string, text string")


def urls_in(value, at=""):
    if isinstance(value, str):
        return [(at, value)] if at.endswith("url") else []
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in urls_in(v, f"{at}[{i}]")]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in urls_in(v, f"{at}.{k}" if at else k)]
    return []


def test_json_of_any_depth_by_force(spark):
    deep = {"url": "/deep"}
    for i in range(30):
        deep = {"x": [deep, i]} if i % 2 else {"y": deep}
    values = [[{"slug": "jane", "avatar": {"url": "a.png"}}, {"ogImage": {"url": "b.png", "width": 3}, "siteurl": "c", "URL": "no", "url": None}], {"url": "top", "urls": ["no"], "a b": {"url": 'q"uo\\te'}}, deep, "url", 5, [], {}, [[["x"], {"url": ""}]]]
    named = {f"f{i}": json.dumps(v) for i, v in enumerate(values)} | {"bad": "{", "empty": ""}
    got = sorted((r["file"], r["field"], r["url"]) for r in M.json_urls(files(spark, **named)).collect() if r["url"] is not None)
    assert got == sorted((f"f{i}", at, u) for i, v in enumerate(values) for at, u in urls_in(v))
    assert {r["file"] for r in M.json_urls(files(spark, **named)).filter("field = 'invalid-json'").collect()} == {"bad", "empty"}
    assert M.json_urls(files(spark)).count() == 0


def found(spark, entries, registries=None):
    return M.found(files(spark, **entries), files(spark, **(registries or {})), PROFILE)


def test_front_matter_and_its_variants_are_scanned(spark):
    text = "\n".join(["---", "slug: one", "image:", f'  url: "{UP}hero.png"', "  variants:", f"    - url: '{UP}hero-300.png'", "      width: 300", "source:", "  curl: no", "---", "", "<p>Body.</p>"])
    got = {(r["field"], r["asset"]["key"]) for r in found(spark, {"a": text, "b": text.replace("\n", "\r\n"), "c": "no --- front\n---\nurl: x"}).collect()}
    assert got == {("front-matter url", "uploads:2026/01/hero.png"), ("front-matter url", "uploads:2026/01/hero-300.png")}


def test_a_reference_without_a_file_is_missing_and_a_file_without_one_unclaimed(spark):
    refs = found(spark, {"a": f'<img src="{UP}here.png"><img src="{UP}absent.png?v=1"><a href="/about/">x</a>'})
    captured = spark.createDataFrame([("media/2026/01/here.png",), ("media/2026/01/orphan.png",)], "file string")
    assert sorted(tuple(r) for r in M.verify(refs, captured).collect()) == [("MISSING", "uploads:2026/01/absent.png", "media/2026/01/absent.png"), ("UNCLAIMED", "media/2026/01/orphan.png", "")]


def test_two_hosts_and_one_file_are_a_conflict(spark):
    refs = found(spark, {"a": "".join(f'<img src="https://{h}{UP}a.png">' for h in ("source.example", "www.mirror.example"))})
    assert [tuple(r) for r in M.verify(refs, spark.createDataFrame([("media/2026/01/a.png",)], "file string")).collect()] == [("CONFLICT", "uploads:2026/01/a.png", "mirror.example and source.example")]


def test_one_file_in_many_spellings_is_owned_once(spark):
    spelled = [f"{UP}a.png", f"https://source.example{UP}a.png", f"//www.source.example{UP}a.png", f"{UP}a.png?ver=9"]
    refs = found(spark, {"a": "".join(f'<img src="{u}">' for u in spelled)})
    assert [(r["key"], r["file"], r["references"]) for r in M.plan(refs).collect()] == [("uploads:2026/01/a.png", "media/2026/01/a.png", 4)]
    assert {r["classification"]: (r["n"], r["urls"]) for r in M.discover(refs).collect()} == {c: ((4, 4) if c == "SUPPORTED" else (0, 0)) for c in M.CLASSES}


def test_manifest_rows(spark):
    body = f'<img src="{UP}a.png" srcset="https://else.example/x.png 2x"><img src="relative.png"><img src="relative.png"><img src="data:image/gif;base64,A">'
    got = sorted(tuple(r) for r in M.manifest(found(spark, {"a": body}, {"r.json": f'{{"url": "{UP}a.png"}}'})).collect())
    assert got == [
        ("assets", "uploads:2026/01/a.png", "/media/2026/01/a.png", 2), ("hosts", "else.example", None, 1), ("references", "EXTERNAL", None, 1), ("references", "SUPPORTED", None, 2), ("references", "UNSUPPORTED", None, 3),
        ("unsupported", "data:image/gif;base64,A", None, 1), ("unsupported", "relative.png", None, 2),
    ]


@pytest.mark.parametrize("raw", ["https://", "//", "http://[bad", "/wp-content/uploads/../../../etc/passwd"])
def test_malformed_references_name_no_file(spark, raw):
    assert M.plan(found(spark, {"a": f'<img src="{raw}">'})).count() == 0


def test_nulls_and_nothing(spark):
    t = spark.createDataFrame([("a", None)], "file string, text string")
    assert M.found(t, t, PROFILE).count() == 0
    assert M.verify(M.found(t, t, PROFILE), t.select(F.lit("media/x").alias("file"))).count() == 1


def test_a_manifest_reads_its_references_once(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    flat = spark.createDataFrame(pd.DataFrame({"url": ["https://away.example/a.png", "#x", f"{UP}a.png", f"{UP}a.png"], "kind": ["EXTERNAL", "UNSUPPORTED", "SUPPORTED", "SUPPORTED"], "key": [None, None, "k", "k"]})).coalesce(1)
    flat = flat.mapInPandas(counted, flat.schema)
    asset = "named_struct('classification', kind, 'key', key, 'local', if(key is null, null, '/media/k'), 'host', if(kind = 'EXTERNAL', 'away.example', '')) as asset"
    got = sorted(tuple(str(x) for x in r) for r in M.manifest(flat.selectExpr("'f' as file", "'src' as field", "url", asset)).collect())
    assert got == [("assets", "k", "/media/k", "2"), ("hosts", "away.example", "None", "1"), ("references", "EXTERNAL", "None", "1"), ("references", "SUPPORTED", "None", "2"), ("references", "UNSUPPORTED", "None", "1"), ("unsupported", "#x", "None", "1")]
    assert seen.value == 4
