"""Evidence and artifacts: dated JSON, front matter, redirects, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_dated(df: DataFrame, root: str, day: str, name: str) -> None:
    """JSON lines under root/name/day=...; a day written again replaces that day."""
    df.write.mode("overwrite").json(f"{root}/{name}/day={day}")


def yaml_scalar(v: Column) -> Column:
    """A YAML scalar: plain where that is safe and is not read as another type, else quoted."""
    plain = v.rlike(r"^[A-Za-z][A-Za-z0-9 _./-]*$") & ~v.rlike(r"(?i)^(true|false|null|yes|no|on|off|y|n|~)$") & ~v.endswith(" ")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(plain, v).otherwise(quoted)


def front_matter_text(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A Markdown file with front matter; null fields are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_scalar(c.cast("string")))) for k, c in fields]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"), body)


def netlify_lines(rules: DataFrame, splats: DataFrame) -> DataFrame:
    """line: one redirect a row, rules before splats."""
    a = rules.select(F.lit(0).alias("o"), F.concat_ws(" ", "from_path", "to_path", F.col("status").cast("string")).alias("line"))
    b = splats.select(F.lit(1).alias("o"), F.concat(F.col("prefix"), F.lit("/* /:splat "), F.col("status").cast("string")).alias("line"))
    return a.unionByName(b).orderBy("o", "line").select("line")


def robots_text(preview: bool, origin: str | None) -> str:
    """robots.txt: a preview keeps all crawlers out."""
    if preview:
        return "User-agent: *\nDisallow: /\n"
    return "User-agent: *\nAllow: /\n" + (f"Sitemap: {origin.rstrip('/')}/sitemap.xml\n" if origin else "")


def manifest_json(routes: DataFrame) -> DataFrame:
    """One JSON document of all routes in path order, and the number of paths claimed twice (which must be 0 to publish).

    A manifest is one document by its format, so its rows meet in one; it holds a short line a route.
    """
    r = routes.agg(F.array_sort(F.collect_list(F.struct("path", "file", "kind", "origin"))).alias("routes"), F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("d"))
    return r.select(F.to_json(F.struct("routes")).alias("json"), (F.col("n") - F.col("d")).alias("repeated"))


def search_index(docs: DataFrame) -> DataFrame:
    """locale, id, json: an entry of a locale's search index; a writer orders by locale and id. docs: id, locale, title, summary, url."""
    entry = F.to_json(F.struct("id", "title", "summary", "url"), {"ignoreNullFields": "false"})
    return docs.select("locale", "id", entry.alias("json"))


def digest_text(lines: Column) -> Column:
    """A digest file's text: its lines, each with a line's end."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))
