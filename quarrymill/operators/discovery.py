"""Search and related content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .batches import bounded
from .dom import folded as fold

# Weights of fields.
WEIGHTS = (("title", 4), ("categories", 3), ("tags", 2), ("summary", 1))


#: Facets of an item whose subsets are listed; items with more meet the others in pairs.
FEW = 8


def folded(c: Column) -> Column:
    """Lower case without the marks of Latin letters, in Arrow batches; plain texts need no tables."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.lower() if x.isascii() else fold(x))

    bounded(SparkSession.active())
    return run(c)


def _begins(field: str, word: str):
    return F.exists(field, lambda x: x.startswith(word))


def search(docs: DataFrame, query: str, locale: str, k: int | None = None) -> DataFrame:
    """id, score, matched, rank: every query word must begin a word of some field; a field counts once, by its best weight a word.

    docs: id, title, summary, categories, tags, locale, date. The scan projects and scores; only hits are ranked.
    """
    words = [w for w in docs.sparkSession.range(1).select(T.search_terms(F.lit(fold(query))).alias("w")).first()["w"]]
    t = docs.filter(F.col("locale") == locale)
    if not words:
        return t.limit(0).select("id", F.lit(0).alias("score"), F.lit("").alias("matched"), F.lit(0).cast("long").alias("rank"))
    one = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit(""))
    text = {"title": F.coalesce("title", F.lit("")), "summary": F.coalesce("summary", F.lit("")), "categories": one("categories"), "tags": one("tags")}
    t = t.select("id", "date", *[folded(c).alias(f"t_{n}") for n, c in text.items()])  # once a document
    t = t.select("id", "date", *[T.search_terms(F.col(f"t_{n}")).alias(f"f_{n}") for n in text])
    score, good = F.lit(0), F.lit(True)
    for w in words:
        hit = {n: _begins(f"f_{n}", w) for n, _ in WEIGHTS}
        best = F.lit(0)
        for n, p in reversed(WEIGHTS):
            best = F.when(hit[n], p).otherwise(best)
        score, good = score + best, good & (best > 0)
    matched = F.array_join(F.array_compact(F.array(*[F.when(F.greatest(*[_begins(f"f_{n}", w) for w in words], F.lit(False)), n) for n, _ in WEIGHTS])), ",")
    hits = t.filter(good).select("id", "date", score.alias("score"), matched.alias("matched"))
    w = Window.orderBy(F.desc("score"), F.desc("date"), "id")
    if k is not None:  # a top-k report: each task keeps k before one ranks them
        hits = hits.orderBy(F.desc("score"), F.desc("date"), "id").limit(k)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).select("id", "score", "matched", "rank")


def _newest(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k newest rows a key, in two steps, so that no task sorts all rows of a hot key."""
    order = (F.desc("date"), F.col("other"))
    for by in ([*keys, F.pmod(F.xxhash64("other"), F.lit(64))], keys):
        rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n_") <= k)
    return rows.drop("n_")


def related(items: DataFrame, k: int = 3) -> DataFrame:
    """id, other, score, rank: the k items that share most facets with each; 2 a category, 1 a tag, repeats on the left count.

    items: id, locale, date, categories, tags. Every set of facets that an item has is a key under which its locale's newest k + 1
    items are listed. A partner among the best k that shares the set T with an item is among the first k of T's list: those before
    it there share as much and are newer. So each item reads the lists of its own sets, and the work follows the number of items.
    Items of more than ``FEW`` facets have too many sets; they meet others in pairs that share a facet.
    """
    weighted = F.concat(F.transform("categories", lambda c: F.struct(F.concat(F.lit("c:"), c).alias("f"), F.lit(2).alias("w"))), F.transform("tags", lambda c: F.struct(F.concat(F.lit("t:"), c).alias("f"), F.lit(1).alias("w"))))
    weighted = F.coalesce(weighted, F.array().cast("array<struct<f:string,w:int>>"))
    names = F.array_sort(F.array_distinct(F.transform(weighted, lambda x: x["f"])))
    t = items.select("id", "locale", "date", weighted.alias("x"), names.alias("f")).filter(F.size("f") > 0)
    own = F.transform("f", lambda f: F.struct(f.alias("f"), F.aggregate(F.filter("x", lambda x: x["f"] == f), F.lit(0), lambda s, x: s + x["w"]).alias("w")))
    t = t.select("id", "locale", "date", own.alias("f"), (F.size("f") <= FEW).alias("few"))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("f")).cast("int") - 1)
    sets = t.filter("few").select("id", "locale", "date", F.explode(F.transform(masks, lambda m: F.filter("f", lambda x, i: F.getbit(m, i) == 1))).alias("s"))
    sets = sets.select("id", "locale", "date", F.array_join(F.transform("s", lambda x: x["f"]), "\n").alias("key"), F.aggregate("s", F.lit(0), lambda a, x: a + x["w"]).alias("score"))
    lists = _newest(sets.select(F.col("id").alias("other"), "locale", "date", "key"), ["locale", "key"], k + 1)
    near = sets.select("id", "locale", "key", "score").join(lists, ["locale", "key"]).filter("id <> other").groupBy("id", "other", "date").agg(F.max("score").alias("score"))
    each = t.select("id", "locale", "date", "few", F.explode("f").alias("x")).select("id", "locale", "date", "few", "x.f", "x.w")
    right = each.select(F.col("id").alias("other"), "locale", "date", F.col("few").alias("few_2"), "f")
    pairs = each.drop("date").join(right, ["locale", "f"]).filter("id <> other and not (few and few_2)").groupBy("id", "other", "date").agg(F.sum("w").alias("score"))
    if t.filter("not few").isEmpty():
        pairs = pairs.limit(0)
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("date"), "other")
    both = near.unionByName(pairs)
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("id", "other", F.col("score").cast("long").alias("score"), "rank")
