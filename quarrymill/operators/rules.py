"""Row rules: conditions with codes, evaluated in one projection and exploded to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H

TITLE_MOST, DESCRIPTION_LEAST, DESCRIPTION_MOST = 60, 50, 160


def findings(df: DataFrame, at: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """at, code for every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
    return df.select(at, F.explode(broken).alias("code"))


def seo_findings(pages: DataFrame, at: str, html: str) -> DataFrame:
    """at, code of title, description, canonical and language rules, and titles that pages share. Tags are extracted once a page."""
    h = F.col(html)
    t = pages.select(at, H.title_of(h).alias("title"), H.meta(h, "description").alias("description"), H.canonicals(h).alias("canonicals"), H.html_lang(h).alias("lang"))
    d = F.trim(F.coalesce("description", F.lit("")))
    own = findings(t, at, [
        ("title-missing", F.coalesce(F.col("title"), F.lit("")) == ""), ("title-too-long", F.length("title") > TITLE_MOST), ("description-missing", d == ""),
        ("description-too-long", F.length("description") > DESCRIPTION_MOST), ("description-too-short", (d != "") & (F.length("description") < DESCRIPTION_LEAST)),
        ("description-repeats-title", (d != "") & (d == F.col("title"))), ("canonical-missing", F.size("canonicals") == 0), ("canonical-repeated", F.size("canonicals") > 1),
        ("lang-missing", F.col("lang").isNull()),
    ])
    shared = t.filter("title <> ''").groupBy("title").agg(F.min(at).alias(at), F.count(F.lit(1)).alias("n")).filter("n > 1").select(at, F.lit("title-shared").alias("code"))
    return own.unionByName(shared)


def provenance_rules() -> list[tuple[str, Column]]:
    """Rules of a provenance block: origin, source_id, captured_at, derived_by."""
    wp = F.col("origin") == "wordpress"
    return [
        ("unknown-origin", ~F.col("origin").isin("wordpress", "authored", "sample", "derived")), ("wordpress-without-id", wp & F.col("source_id").isNull()), ("wordpress-without-date", wp & F.col("captured_at").isNull()),
        ("bad-id", F.col("source_id").isNotNull() & ~F.col("source_id").rlike("^[1-9][0-9]*$")), ("derived-without-author", (F.col("origin") == "derived") & (F.coalesce("derived_by", F.lit("")) == "")), ("author-without-derived", (F.col("origin") != "derived") & F.col("derived_by").isNotNull()),
    ]
