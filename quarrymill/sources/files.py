"""Trees of files as DataFrames: text, bytes and listings. Paths are relative to the root and sorted only where a caller asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relative(path: Column, root: str) -> Column:
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_replace(path, rf"^.*?/\Q{tail}\E/", "")


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file, text of the files below a folder whose names match; a row a file."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return t.select(relative(F.col("_metadata.file_path"), root).alias("file"), F.col("value").alias("text"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file, bytes; contents are not read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return t.select(relative(F.col("path"), root).alias("file"), F.col("length").alias("bytes"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Markdown entries: every .md file but README.md, with its collection (the first folder)."""
    t = texts(spark, root, "*.md").filter(~F.col("file").rlike("(^|/)README\\.md$"))
    return t.withColumn("collection", F.regexp_extract("file", "^([^/]+)/", 1))


def is_redirect_stub(html: Column) -> Column:
    """A meta refresh among the first thousand characters."""
    return F.substring(html, 1, 1000).rlike(r"""(?i)<meta[^>]+http-equiv=["']?refresh""")


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """file, html, css: pages that are no redirect stubs, with the text of their style elements and linked stylesheets."""
    t = texts(spark, root, "*.html").withColumnRenamed("text", "html").filter(~is_redirect_stub(F.col("html")))
    sheets = texts(spark, root, "*.css").select(F.concat(F.lit("/"), "file").alias("sheet"), F.col("text").alias("rules"))
    links = t.select("file", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<link[^>]+rel=["']?stylesheet["']?[^>]*href=["']([^"']+)["']"""), 1)).alias("sheet"))
    linked = links.join(sheets, "sheet").groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("rules")), "\n").alias("linked"))
    own = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), 1), "\n")
    return t.withColumn("own", own).join(linked, "file", "left").select("file", "html", F.concat_ws("\n", "own", "linked").alias("css"))


def built_routes(spark: SparkSession, root: str) -> DataFrame:
    """key, file, canonical, redirect of a built site: pages, data files and stubs, internal assets left out."""
    t = texts(spark, root, "*.{html,json,xml,txt}").filter(~F.col("file").startswith("_astro/"))
    p = F.concat(F.lit("/"), "file")
    key = F.when(p.endswith("/index.html"), F.regexp_replace(p, "index\\.html$", "")).otherwise(p)
    canon = F.regexp_extract("text", r"""(?i)<link[^>]+rel=["']?canonical["']?[^>]*href=["']([^"']+)""", 1)
    return t.select(key.alias("key"), "file", F.when(canon != "", canon).alias("canonical"), (F.col("file").endswith(".html") & is_redirect_stub(F.col("text"))).alias("redirect"))


def servable_routes(spark: SparkSession, root: str) -> DataFrame:
    """path of every page that a reader can open, sorted."""
    return built_routes(spark, root).filter(F.col("file").endswith(".html") & ~F.col("redirect")).select(F.col("key").alias("path")).orderBy("path")


def newest(paths: DataFrame, prefix: str) -> DataFrame:
    """The lexicographically last name with a prefix; null without one."""
    return paths.filter(F.col("name").startswith(prefix)).agg(F.max("name").alias("name"))


# Folders of a tree that hold no documents of its own.
IGNORED = (".git", "node_modules", "dist", ".astro")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """file, text of the Markdown files below a folder, those of tools and builds left out."""
    parts = F.split("file", "/", -1)
    return texts(spark, root, "*.md").filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """file, text of the recorded render digests in a folder."""
    return texts(spark, root, "*.txt")
