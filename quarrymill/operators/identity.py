"""Duplicates and claims: every violation is a row, nothing is dropped on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sole_claimant(df: DataFrame, key: Column | str, by: Column | str) -> DataFrame:
    """key, n, claimants: keys that more than one row claims, with all claimants, sorted. One shuffle, on the key."""
    t = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(by) if isinstance(by, str) else by).cast("string").alias("by"))
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("by")), ",").alias("claimants")).filter("n > 1")


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows after the first of each key, with their number."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("nth > 1")


def first_wins(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): the first row of each key, and later rows with the first one's order value."""
    w = Window.partitionBy(key).orderBy(order)
    t = df.withColumn("nth_", F.row_number().over(w)).withColumn("first_", F.first(order).over(w))
    return t.filter("nth_ = 1").drop("nth_", "first_"), t.filter("nth_ > 1").withColumnRenamed("first_", "kept").drop("nth_")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an explicit order, as an aggregate: it is combined before it moves."""
    cols = df.columns
    return df.groupBy(F.col(key).alias("k_")).agg(F.max_by(F.struct(*cols), order).alias("r_")).select("r_.*")


def cluster_issues(df: DataFrame, default_locale: str) -> DataFrame:
    """cluster, code, detail: repeated locales (each after the first), no member in the default locale (then nothing more),
    slugs that differ from the default member's. df: cluster, locale, slug, id."""
    w = Window.partitionBy("cluster", "locale").orderBy("id")
    t = df.withColumn("nth", F.row_number().over(w))
    again = t.filter("nth > 1").select("cluster", F.lit("duplicate-locale").alias("code"), F.concat_ws(":", "locale", F.col("id").cast("string")).alias("detail"))
    has = df.groupBy("cluster").agg(F.min(F.when(F.col("locale") == default_locale, F.struct("id", "slug"))).alias("source"))
    none = has.filter(F.col("source").isNull()).select("cluster", F.lit("missing-source").alias("code"), F.lit(default_locale).alias("detail"))
    off = df.join(has.filter(F.col("source").isNotNull()), "cluster").filter(F.col("slug") != F.col("source.slug"))
    return again.unionByName(none).unionByName(off.select("cluster", F.lit("slug-mismatch").alias("code"), F.concat_ws(":", F.col("id").cast("string"), "slug").alias("detail")))


def missing(df: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    """Rows whose key the registry lacks."""
    return df.join(registry, on, "left_anti")


def both_ways(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """key, side: what only one of two inventories has. One shuffle of each side, on the key."""
    a, b = left.select(F.col(on).alias("key")).distinct().withColumn("l", F.lit(1)), right.select(F.col(on).alias("key")).distinct().withColumn("r", F.lit(1))
    return a.join(b, "key", "full").filter("l is null or r is null").select("key", F.when(F.col("l").isNull(), "right-only").otherwise("left-only").alias("side"))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """id, severity, decision: known errors become baseline, baseline ids that nothing produced become stale errors."""
    known = findings.join(baseline, "id", "left").select("id", F.when((F.col("severity") == "error") & F.col("decision").isNotNull(), "baseline").otherwise(F.col("severity")).alias("severity"), "decision")
    stale = baseline.join(findings.select("id").distinct(), "id", "left_anti").select("id", F.lit("stale").alias("severity"), "decision")
    return known.unionByName(stale)


def shared_values(left: Column, right: Column) -> Column:
    """Values of the left array that the right has, in the left's order and with its repeats."""
    return F.filter(left, lambda x: F.array_contains(right, x))


def fingerprint(df: DataFrame, name: str, value: str) -> DataFrame:
    """One digest over all rows by name; "unavailable" without rows. Each row is digested first, so what is gathered is a short line a row."""
    line = F.concat(F.col(name), F.lit("\n"), F.sha2(F.col(value), 256))
    return df.agg(F.collect_list(line).alias("l")).select(F.when(F.size("l") == 0, "unavailable").otherwise(F.sha2(F.array_join(F.array_sort("l"), "\n"), 256)).alias("fingerprint"))
