"""What registries say about themselves and about provenance: decisions, rulings, manifests, claims, media references of JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from .identity import sole_claimant
from .media import front_matter_urls, json_urls
from .rules import findings

# Months of long dates.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
# Origins of routes in a manifest.
ORIGINS = ("post", "page", "custom", "taxonomy", "author", "listing", "static", "data", "redirect", "unknown")


def long_date(day: Column, locale: str) -> Column:
    """A date in words, by the locale's own order."""
    m = F.array(*[F.lit(x) for x in MONTHS[locale].split()])[F.month(day) - 1]
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return {"en": F.concat(m, F.lit(" "), d, F.lit(", "), y), "fr": F.concat_ws(" ", d, m, y), "de": F.concat(d, F.lit(". "), m, F.lit(" "), y), "es": F.concat_ws(" de ", d, m, y)}[locale]


def decision_problems(rows: DataFrame) -> DataFrame:
    """id, code. rows: id, status, resolution, impact."""
    twice = sole_claimant(rows, "id", "id").select(F.col("key").alias("id"), F.lit("recorded-twice").alias("code"))
    done = F.col("status") == "resolved"
    return twice.unionByName(findings(rows, "id", [
        ("bad-id", ~F.col("id").rlike(r"^D-\d{3}-\d+$")), ("no-resolution", done & (F.coalesce("resolution", F.lit("")) == "")), ("impact-after-resolution", done & F.col("impact").isNotNull()), ("pending-without-impact", ~done & F.col("impact").isNull()),
    ]))


def ruling_problems(rows: DataFrame) -> DataFrame:
    """key, code. rows: key, verdict, why: a reason says something, and one for other words says which."""
    return findings(rows, "key", [("short-reason", F.length(F.trim("why")) < 40), ("no-wording", (F.col("verdict") == "reworded") & ~F.col("why").rlike(r"(?i)\b(reads|says|labels|calls|renders)\b"))])


def stale_rulings(rulings: DataFrame, used: DataFrame) -> DataFrame:
    """Rulings that nothing asked for."""
    return rulings.select("key").distinct().join(used.select("key"), "key", "left_anti")


def manifest_problems(routes: DataFrame) -> DataFrame:
    """at, code of manifest rows (path, file, kind, origin, entry): shapes, known kinds and origins, paths claimed once, content with an entry."""
    t = routes.withColumn("at", F.col("path"))
    own = findings(t, "at", [
        ("path-not-rooted", ~F.col("path").startswith("/")), ("no-file", F.coalesce("file", F.lit("")) == ""), ("unknown-kind", ~F.col("kind").isin("page", "data", "redirect")), ("unknown-origin", ~F.col("origin").isin(*ORIGINS)),
        ("content-without-entry", F.col("origin").isin("post", "page", "custom") & F.col("entry").isNull()), ("page-file-mismatch", (F.col("kind") == "page") & F.col("path").endswith("/") & (U.page_file(F.col("path")) != F.col("file"))),
    ])
    return own.unionByName(sole_claimant(routes, "path", "file").select(F.col("key").alias("at"), F.lit("path-claimed-twice").alias("code")))


def provenance_claims(entries: DataFrame, registries: list[tuple[str, DataFrame]]) -> DataFrame:
    """local, origin, source, claimant: what entries (file, id, system, source_id, type, locale) and registries' rows (file, slug, system, source_id) claim."""
    key = lambda kind, type_, locale: F.when(F.col("source_id").isNotNull(), U.source_key(F.lit(kind), type_, F.col("source_id"), locale))
    out = entries.select(F.col("id").alias("local"), F.col("system").alias("origin"), key("post", F.col("type"), F.col("locale")).alias("source"), F.col("file").alias("claimant"))
    for name, df in registries:
        kind = "user" if name == "authors" else "term"
        out = out.unionByName(df.select(F.concat(F.lit(f"{name}/"), "slug").alias("local"), F.col("system").alias("origin"), key(kind, F.lit(name), F.lit(None).cast("string")).alias("source"), F.col("file").alias("claimant")))
    return out


def contested_claims(claims: DataFrame) -> DataFrame:
    """Sources that more than one local row claims."""
    return sole_claimant(claims.filter("source is not null"), "source", "local")


def media_references(entries: DataFrame, registries: DataFrame) -> DataFrame:
    """file, field, url of a content tree, unclassified. entries (file, text): bodies and front matter; registries (file, text): JSON of any depth."""
    front = F.regexp_extract("text", r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    body = F.regexp_replace("text", r"^---\r?\n[\s\S]*?\r?\n---", "")
    a = entries.select("file", F.explode(H.references(body)).alias("r")).select("file", F.col("r.kind").alias("field"), F.col("r.url").alias("url"))
    b = entries.select("file", F.explode(front_matter_urls(front)).alias("url")).select("file", F.lit("front-matter").alias("field"), "url")
    return a.unionByName(b).unionByName(json_urls(registries))
