"""Registries, manifests, redirect maps, front matter, sitemaps and Markdown, with problems as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import bounded


def registry(spark: SparkSession, path: str, schema: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a JSON array of rows. A file that is no array, and rows with unknown fields, are problems."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("v"))
    raw = text.withColumn("a", F.from_json("v", f"array<{schema}>")).withColumn("m", F.from_json("v", "array<map<string,string>>"))
    whole = raw.filter(F.col("a").isNull() | ~F.trim("v").startswith("[")).select("file", F.lit("not-an-array").alias("code"), F.lit("").alias("detail"))
    keys = raw.filter(F.trim("v").startswith("[")).select("file", F.explode("m").alias("m")).select("file", F.explode(F.array_except(F.map_keys("m"), F.array(*[F.lit(a) for a in allowed]))).alias("k"))
    rows = raw.filter(F.trim("v").startswith("[")).select("file", F.posexplode("a").alias("pos", "r")).select("file", "pos", "r.*")
    return rows, whole.unionByName(keys.select("file", F.lit("unknown-field").alias("code"), F.col("k").alias("detail")))


def manifest_routes(spark: SparkSession, path: str) -> DataFrame:
    """path, file, kind, origin, entry of a deployment manifest; missing values take page and unknown."""
    schema = "routes array<struct<path:string,file:string,kind:string,origin:string,entry:string>>"
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["routes"]).alias("r")).select("r.*")
    return t.withColumn("kind", F.coalesce("kind", F.lit("page"))).withColumn("origin", F.coalesce("origin", F.lit("unknown")))


def redirect_map(text: Column) -> Column:
    """struct(rules, splats) of a redirect map's JSON."""
    return F.from_json(text, "rules array<struct<`from`:string,`to`:string,status:int,family:string>>, splats array<struct<prefix:string,status:int,family:string>>")


def redirect_problems(spark: SparkSession, path: str) -> DataFrame:
    """code, detail: statuses other than 301 and 302, missing families, sources with a closing slash, splats at the root."""
    t = spark.read.text(path, wholetext=True).select(redirect_map(F.col("value")).alias("m"))
    r = t.select(F.explode("m.rules").alias("r")).select(F.col("r.from").alias("at"), "r.status", "r.family", F.lit(False).alias("splat"))
    s = t.select(F.explode("m.splats").alias("r")).select(F.col("r.prefix").alias("at"), "r.status", "r.family", F.lit(True).alias("splat"))
    from ..operators.rules import findings

    return findings(r.unionByName(s), "at", [
        ("bad-status", ~F.coalesce(F.col("status"), F.lit(0)).isin(301, 302)), ("no-family", F.coalesce("family", F.lit("")) == ""),
        ("slash-at-end", ~F.col("splat") & F.col("at").endswith("/") & (F.col("at") != "/")), ("splat-at-root", F.col("splat") & F.col("at").isin("", "/")),
    ])


def cms_types(text: Column) -> Column:
    """array of struct(name, slug, rest_base, hierarchical, taxonomies) of the listing of content types or taxonomies that a CMS answers, an object by name,
    sorted by name: without a rest_base it is the name, without a slug too; null for what is no object."""
    kind = "map<string,struct<slug:string,rest_base:string,hierarchical:boolean,taxonomies:array<string>,types:array<string>>>"
    none = F.array().cast("array<string>")
    row = lambda e: F.struct(
        e["key"].alias("name"), F.coalesce(e["value"]["slug"], e["key"]).alias("slug"), F.coalesce(e["value"]["rest_base"], e["key"]).alias("rest_base"), F.coalesce(e["value"]["hierarchical"], F.lit(False)).alias("hierarchical"),
        F.coalesce(e["value"]["taxonomies"], e["value"]["types"], none).alias("taxonomies"),
    )
    return F.when(F.ltrim(text).startswith("{"), F.array_sort(F.transform(F.map_entries(F.from_json(text, kind)), row)))


def sitemap_urls(xml: Column) -> Column:
    """The loc values of a sitemap or of a sitemap index, decoded."""
    from ..functions.text import decode_entities

    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: decode_entities(F.replace(u, F.lit("&apos;"), F.lit("'"))))


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex\b")


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)


def _value(v: str):
    v = v.strip()
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    return v.split(" #", 1)[0].rstrip()


def parse_front_matter(text: str) -> dict[str, list[str]] | None:
    """Fields of a leading block between --- lines: scalars, dotted nested keys and sequences, each as a list; null without a block."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---" or not any(x.strip() == "---" for x in lines[1:]):
        return None
    out: dict[str, list[str]] = {}
    top = key = ""
    for line in lines[1:]:
        if line.strip() == "---":
            break
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- "):
            if key:
                out.setdefault(key, []).append(_value(bare[2:]))
            continue
        name, colon, rest = bare.partition(":")
        if not colon:
            continue
        if line[0] in " \t":
            key = f"{top}.{name.strip()}" if top else name.strip()
        else:
            top = key = name.strip()
        rest = rest.strip()
        if rest.startswith("[") and rest.endswith("]"):
            out[key] = [_value(x) for x in rest[1:-1].split(",") if x.strip()]
        elif rest:
            out[key] = [_value(rest)]
    return out


def front_matter(entries: DataFrame) -> DataFrame:
    """file, fields (map of lists), problem: entries (file, text) read in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_front_matter(t) for t in b["text"]]
            yield pd.DataFrame({"file": b["file"], "fields": [list((g or {}).items()) for g in got], "problem": [None if g is not None else "no-front-matter" for g in got]})

    bounded(entries.sparkSession)
    t = entries.select("file", "text").mapInPandas(run, "file string, fields array<struct<k:string,v:array<string>>>, problem string")
    return t.select("file", F.map_from_entries("fields").alias("fields"), "problem")


def _fence(line: str) -> str:
    """The run of three or more backticks or tildes that begins a line, at most three blanks in."""
    bare = line.lstrip()
    mark = bare[:1]
    if mark not in ("`", "~") or not mark or len(line) - len(bare) > 3:
        return ""
    run = bare[: len(bare) - len(bare.lstrip(mark))]
    return run if len(run) >= 3 else ""


def _heading(line: str) -> tuple[int, str]:
    """Level and text of a line that begins with up to six number signs and a blank; (0, "") for others."""
    rest = line.lstrip("#")
    level = len(line) - len(rest)
    if not 1 <= level <= 6 or not rest[:1].isspace():
        return 0, ""
    return level, rest.strip().rstrip("#").rstrip()


def parse_markdown(text: str) -> list[tuple[int, str, bool, int, str]]:
    """(line, text, fenced, heading level or 0, heading text): a fence closes with its own mark; an open one takes the rest."""
    out, fence = [], ""
    for i, line in enumerate(text.split("\n"), 1):
        run = _fence(line)
        if fence:
            out.append((i, line, True, 0, ""))
            if run and run[0] == fence[0] and len(run) >= len(fence):
                fence = ""
            continue
        if run:
            fence = run
            out.append((i, line, True, 0, ""))
            continue
        out.append((i, line, False, *_heading(line)))
    return out


def markdown_lines(docs: DataFrame) -> DataFrame:
    """file, line, text, fenced, level, heading of Markdown documents (file, text); the order-dependent fence state stays in a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *x) for f, t in zip(b["file"], b["text"], strict=True) for x in parse_markdown(t)]
            yield pd.DataFrame(rows, columns=["file", "line", "text", "fenced", "level", "heading"])

    bounded(docs.sparkSession)
    return docs.select("file", "text").mapInPandas(run, "file string, line int, text string, fenced boolean, level int, heading string")


def markdown_headings(lines: DataFrame) -> DataFrame:
    """file, line, level, heading, anchor; repeats of an anchor are numbered."""
    from ..functions.text import anchor_of
    from ..operators.ordering import numbered_anchors

    t = lines.filter("level > 0").select("file", "line", "level", "heading", anchor_of(F.col("heading")).alias("base"))
    return numbered_anchors(t, "file", "base", "line").drop("base")


def markdown_links(lines: DataFrame) -> DataFrame:
    """file, line, label, target of inline links outside fences and code spans."""
    plain = F.regexp_replace("text", "`[^`]*`", "")
    pat = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    t = lines.filter(~F.col("fenced")).select("file", "line", F.arrays_zip(F.regexp_extract_all(plain, F.lit(pat), 1).alias("l"), F.regexp_extract_all(plain, F.lit(pat), 2).alias("t")).alias("z"))
    return t.select("file", "line", F.explode("z").alias("z")).select("file", "line", F.col("z.l").alias("label"), F.col("z.t").alias("target"))


def broken_markdown_links(links: DataFrame, headings: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, target, code: missing files and missing anchors; links of other schemes are not checked."""
    t = links.filter(~F.col("target").rlike("^[a-z][a-z0-9+.-]*:"))
    t = t.withColumn("to", F.regexp_extract("target", "^([^#]*)", 1)).withColumn("anchor", F.regexp_extract("target", "#(.*)$", 1))
    root = F.regexp_extract("file", "^(.*/)?[^/]*$", 1)
    t = t.withColumn("to", F.when(F.col("to") == "", F.col("file")).otherwise(F.regexp_replace(F.concat(root, "to"), r"(^|/)\./", "$1")))
    lost = t.join(files.select(F.col("file").alias("to")), "to", "left_anti").select("file", "line", "target", F.lit("missing-file").alias("code"))
    here = t.filter("anchor <> ''").join(files.select(F.col("file").alias("to")), "to", "left_semi")
    none = here.join(headings.select(F.col("file").alias("to"), "anchor"), ["to", "anchor"], "left_anti").select("file", "line", "target", F.lit("missing-anchor").alias("code"))
    return lost.unionByName(none)
