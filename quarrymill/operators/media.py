"""Media of a content tree: found wherever a file names it, classified, owned once, compared with what was captured.

JSON of any depth is a VARIANT that is opened one level a round: each round explodes objects and arrays, takes the strings whose path ends in
url, and goes on with what nests further. No field list can go stale, and no Python walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.url import MediaProfile, identify_asset
from .lineage import cut

# The classes of references, and those that are migrated.
CLASSES = ("SUPPORTED", "CONFIGURED", "EXTERNAL", "UNSUPPORTED", "MISSING", "CONFLICT")
MIGRATED = ("SUPPORTED", "CONFIGURED")


def json_urls(registries: DataFrame) -> DataFrame:
    """file, field, url of every string whose path ends in url, in JSON files (file, text) of any depth. A file that is no JSON has one row,
    field invalid-json and no url; null texts have none. A path is spelled a.b[0].url."""
    spark = registries.sparkSession
    t = registries.filter("text is not null").select("file", F.try_parse_json("text").alias("v"))
    t = cut(t)
    out = t.filter("v is null").select("file", F.lit("invalid-json").alias("field"), F.lit(None).cast("string").alias("url"))
    open_ = t.filter("v is not null").select("file", F.lit("").alias("at"), "v")
    while True:
        inner = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value")))
        at = F.when(F.col("key").isNull(), F.concat("at", F.lit("["), "pos", F.lit("]"))).otherwise(F.concat_ws(".", F.nullif(F.col("at"), F.lit("")), "key"))
        inner = cut(inner.select("file", at.alias("at"), F.col("value").alias("v"), F.schema_of_variant("value").alias("kind")).filter("kind like 'OBJECT%' or kind like 'ARRAY%' or (kind = 'STRING' and endswith(at, 'url'))"))
        out = out.unionByName(inner.filter("kind = 'STRING'").select("file", F.col("at").alias("field"), F.variant_get("v", "$", "string").alias("url")))
        open_ = inner.filter("kind <> 'STRING'").select("file", "at", "v")
        if open_.isEmpty():
            return out


def collected(html: Column, profile: MediaProfile) -> Column:
    """The different references of a text's attributes and styles that name media of the site's own, sorted."""
    named = F.filter(H.references(html), lambda r: (r["kind"] != "markdown") & identify_asset(r["url"], profile)["classification"].isin(*MIGRATED))
    return F.array_sort(F.array_distinct(F.transform(named, lambda r: F.trim(r["url"]))))


def front_matter_urls(front: Column) -> Column:
    """Values of lines of a front matter block whose key is url, items of a sequence too; a quote at each end goes."""
    lines = F.transform(F.split(front, "\n", -1), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s", " ")), "^- +", ""))
    values = F.transform(F.filter(lines, lambda x: x.startswith("url:")), lambda x: F.trim(F.substring(x, 5, 1 << 30)))
    bare = lambda x: F.when(F.left(x, F.lit(1)).isin('"', "'"), F.substring(x, 2, 1 << 30)).otherwise(x)
    tail = lambda x: F.when(F.right(x, F.lit(1)).isin('"', "'"), F.left(x, F.length(x) - 1)).otherwise(x)
    return F.filter(F.transform(values, lambda x: tail(bare(x))), lambda x: x != "")


def found(entries: DataFrame, registries: DataFrame, profile: MediaProfile) -> DataFrame:
    """file, field, url, asset of a content tree. entries (file, text): every reference form of bodies, a link only where it names a file of the
    site's own, and the url lines of front matter; registries (file, text): every url in them, not classified where the file is no JSON."""
    whole = F.regexp_replace("text", "\r\n", "\n")
    end = F.when(whole.startswith("---\n"), F.locate("\n---", whole, 4)).otherwise(0)
    t = entries.filter("text is not null").select("file", whole.alias("x"), end.alias("e"))
    t = t.select("file", F.when(F.col("e") > 0, F.expr("substring(x, 5, e - 5)")).alias("front"), F.when(F.col("e") > 0, F.expr("substring(x, e + 4)")).otherwise(F.col("x")).alias("body"))
    a = t.select("file", F.explode(H.asset_references(F.col("body"), profile)).alias("r")).select("file", F.col("r.kind").alias("field"), "r.url", "r.asset")
    b = t.filter("front is not null").select("file", F.lit("front-matter url").alias("field"), F.explode(front_matter_urls(F.col("front"))).alias("url"))
    other = b.unionByName(json_urls(registries)).withColumn("asset", F.when(F.col("url").isNotNull(), identify_asset(F.col("url"), profile)))
    return a.unionByName(other)


def discover(references: DataFrame) -> DataFrame:
    """classification, n, urls: how many references fall into each class, and how many spellings; classes without any have zeros."""
    n = references.filter("asset is not null").groupBy(F.col("asset.classification").alias("classification")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))
    every = references.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    return every.join(n, "classification", "left").select("classification", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("urls", F.lit(0)).alias("urls"))


def plan(references: DataFrame) -> DataFrame:
    """key, file, references, hosts: one output file for every asset that is migrated, however many references name it."""
    own = references.filter(F.col("asset.classification").isin(*MIGRATED) & F.col("asset.key").isNotNull())
    each = own.groupBy(F.col("asset.key").alias("key"), F.col("asset.host").alias("host")).agg(F.min("asset.local").alias("local"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("key").agg(F.regexp_replace(F.min("local"), "^/+", "").alias("file"), F.sum("n").alias("references"), F.array_sort(F.collect_set(F.nullif(F.col("host"), F.lit("")))).alias("hosts"))


def verify(references: DataFrame, captured: DataFrame) -> DataFrame:
    """code, key, detail: MISSING (a planned file that was not captured), CONFLICT (several hosts, one file) and UNCLAIMED (a captured file that no
    content names; a note, not a failure). captured: file."""
    p = cut(plan(references))
    kept = captured.select("file").distinct()
    gone = p.join(kept, "file", "left_anti").select(F.lit("MISSING").alias("code"), "key", F.col("file").alias("detail"))
    two = p.filter("size(hosts) > 1").select(F.lit("CONFLICT").alias("code"), "key", F.array_join("hosts", " and ").alias("detail"))
    free = kept.join(p.select("file"), "file", "left_anti").select(F.lit("UNCLAIMED").alias("code"), F.col("file").alias("key"), F.lit("").alias("detail"))
    return gone.unionByName(two).unionByName(free)


def manifest(references: DataFrame) -> DataFrame:
    """section, name, local, n: the rows of a media manifest. assets (a row each, with the number of references), references (classes), hosts
    (external ones), unsupported (each spelling)."""
    known = references.filter("asset is not null")
    owned = F.col("asset.key").isNotNull() & F.col("asset.local").isNotNull()
    row = lambda section, name, local=F.lit(None).cast("string"): F.struct(F.lit(section).alias("section"), name.alias("name"), local.alias("local"))
    away = ~owned & (F.col("asset.classification") == "EXTERNAL") & (F.coalesce("asset.host", F.lit("")) != "")
    refused = ~owned & (F.col("asset.classification") == "UNSUPPORTED")
    # every reference is read once and says in which rows it counts; outer: the planner would else ask for a size first, and compute all of it twice
    counted = F.array_compact(F.array(
        F.when(owned, row("assets", F.col("asset.key"), F.col("asset.local"))), row("references", F.col("asset.classification")), F.when(away, row("hosts", F.col("asset.host"))), F.when(refused, row("unsupported", F.col("url"))),
    ))
    return known.select(F.explode_outer(counted).alias("r")).groupBy("r.section", "r.name").agg(F.min("r.local").alias("local"), F.count(F.lit(1)).alias("n"))
