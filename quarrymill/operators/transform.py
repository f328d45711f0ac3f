"""Captured rows to content: an ordered ladder of exclusions, resolved identities, and a row for everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

# Reasons of exclusion in the order they are asked.
LADDER = ("not-published", "password-protected", "incomplete", "unrepresentable-slug", "duplicate-slug")


def resolve(rows: DataFrame, ids: str, registry: DataFrame, into: str, key: str = "id") -> DataFrame:
    """Adds an array of slugs for an array of registry ids, in order, and the number that did not resolve. registry: id, slug."""
    e = rows.select(key, F.posexplode_outer(ids).alias("p_", "i_")).join(registry.select(F.col("id").alias("i_"), F.col("slug").alias("s_")), "i_", "left")
    g = e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("s_").isNotNull(), F.struct("p_", "s_")))), lambda x: x["s_"]).alias(into), F.count_if(F.col("i_").isNotNull() & F.col("s_").isNull()).alias(f"{into}_lost"))
    return rows.join(g, key, "left")


def ladder(rows: DataFrame) -> DataFrame:
    """Adds reason, why a row is excluded, or null, and lacks, what an incomplete row does not have.

    rows: id, kind (post or page), status (null: published), protected, body, slug, date, modified, title, author, categories, pos.
    Pages need no date of publication, author or category. Of rows of a kind that pass the rest and share a slug the first by
    position stays.
    """
    blank = lambda c: T.squash_ends(F.coalesce(c, F.lit(""))) == ""
    post, day = F.col("kind") == "post", lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1)
    steps = [
        (F.col("status") != "publish", "not-published", None), (F.col("protected"), "password-protected", None), (F.coalesce("body", F.lit("")) == "", "incomplete", "body"),
        (F.col("slug").isNull() | ~U.is_slug(F.col("slug")), "unrepresentable-slug", None), ((day(F.col("modified")) == "") & (day(F.col("date")) == ""), "incomplete", "date"),
        (blank(T.decode_entities(F.coalesce("title", F.lit("")))), "incomplete", "title"), (post & (day(F.col("date")) == ""), "incomplete", "publication date"),
        (post & F.col("author").isNull(), "incomplete", "author"), (post & (F.coalesce(F.size("categories"), F.lit(0)) <= 0), "incomplete", "categories"),
    ]
    reason = lacks = F.lit(None).cast("string")
    for when, code, what in reversed(steps):
        reason, lacks = F.when(when, code).otherwise(reason), F.when(when, F.lit(what).cast("string")).otherwise(lacks)
    t = rows.withColumn("reason", reason).withColumn("lacks", lacks)
    n = F.row_number().over(Window.partitionBy("kind", "slug", F.col("reason").isNull()).orderBy("pos"))
    return t.withColumn("reason", F.when(F.col("reason").isNull() & (n > 1), "duplicate-slug").otherwise(F.col("reason")))


def conservation(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """held, made, excluded, sound: everything held was made or excluded."""
    a = rows.agg(F.count(F.lit(1)).alias("held"))
    b = judged.agg(F.count_if(F.col("reason").isNull()).alias("made"), F.count_if(F.col("reason").isNotNull()).alias("excluded"))
    return a.join(F.broadcast(b)).withColumn("sound", F.col("held") == F.col("made") + F.col("excluded"))


def fill_missing(rows: DataFrame, extra: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows with nulls of some columns filled from a second source."""
    e = extra.select(key, *[F.col(c).alias(f"{c}_2") for c in cols])
    return rows.join(e, key, "left").select(*[F.coalesce(c, f"{c}_2").alias(c) if c in cols else F.col(c) for c in rows.columns])
