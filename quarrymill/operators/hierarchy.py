"""Parent chains and menus by recursion with a guard against loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def chains(df: DataFrame, depth: int = 1 << 20) -> DataFrame:
    """slug, chain (root first), state: ok, unknown-parent or cycle. df: slug, parent.

    Pointer jumping: every round doubles the ancestors known, so a tree of depth d takes log2(d) joins on the slug, each cut off from
    the last by a checkpoint; it ends when no row has an ancestor left to fetch.
    """
    base = df.select("slug", "parent").dropDuplicates(["slug"])
    known = base.select(F.col("slug").alias("p_"), F.lit(True).alias("known_"))
    t = base.join(known, base["parent"] == F.col("p_"), "left").select(
        "slug", F.array("slug").alias("chain"), F.when(F.col("known_"), F.col("parent")).alias("up"), (F.col("parent").isNotNull() & F.col("known_").isNull()).alias("lost"), F.lit(False).alias("loop")
    )
    t = cut(t)
    for _ in range(max(1, depth).bit_length()):
        if t.filter("up is not null").isEmpty():
            break
        up = t.select(F.col("slug").alias("u_"), F.col("chain").alias("c_"), F.col("up").alias("n_"), F.col("lost").alias("l_"), F.col("loop").alias("o_"))
        j = t.join(up, t["up"] == F.col("u_"), "left")
        longer = F.when(F.col("u_").isNotNull(), F.concat("c_", "chain")).otherwise(F.col("chain"))
        loop = F.col("loop") | F.coalesce("o_", F.lit(False)) | (F.size(F.array_distinct(longer)) < F.size(longer))
        t = cut(j.select("slug", F.when(loop, F.col("chain")).otherwise(longer).alias("chain"), F.when(~loop, F.col("n_")).alias("up"), (F.col("lost") | F.coalesce("l_", F.lit(False))).alias("lost"), loop.alias("loop")))
    return t.select("slug", F.when(F.col("loop"), None).otherwise(F.col("chain")).alias("chain"), F.when(F.col("loop"), "cycle").when(F.col("lost"), "unknown-parent").otherwise("ok").alias("state"))


def term_paths(df: DataFrame, base: str, url_hierarchy: bool) -> DataFrame:
    """slug, path: terms whose chain is sound, with their ancestors if the URL carries them."""
    c = chains(df).filter("state = 'ok'")
    tail = F.array_join("chain", "/") if url_hierarchy else F.col("slug")
    return c.select("slug", F.concat(F.lit(f"/{base.strip('/')}/"), tail, F.lit("/")).alias("path"))


def parent_issues(df: DataFrame) -> DataFrame:
    """slug, code: own parent, unknown parent, or a loop on the way up."""
    me = df.filter("slug = parent").select("slug", F.lit("self-parent").alias("code"))
    c = chains(df).filter("state <> 'ok'").join(df.filter("slug = parent").select("slug"), "slug", "left_anti").select("slug", F.col("state").alias("code"))
    return me.unionByName(c)


def tree_depth(paths: DataFrame, menu: str, path: str) -> DataFrame:
    return paths.groupBy(menu).agg(F.max(F.size(path)).cast("long").alias("depth"), F.count(F.lit(1)).alias("items"))


def current_items(paths: DataFrame, menu: str, path: str, current: str) -> DataFrame:
    """Adds contains_current: the item or one below it is current. Every current item marks its own prefixes: a join, not a walk."""
    marks = paths.filter(F.col(current)).select(menu, F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))).alias(path)).distinct().withColumn("m_", F.lit(True))
    return paths.join(marks, [menu, path], "left").withColumn("contains_current", F.coalesce("m_", F.lit(False))).drop("m_")


def crawl_waves(links: DataFrame, seeds: DataFrame, waves: int) -> DataFrame:
    """url, wave: pages reached from the seeds in so many waves of links. links: source, target; seeds: url. A frontier is joined with the
    links and what was seen before is taken off; the number of waves is the crawl's bound."""
    seen = cut(seeds.select("url").distinct().withColumn("wave", F.lit(0)))
    frontier = seen
    for n in range(1, waves + 1):
        new = links.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("wave", F.lit(n))
        new = cut(new)
        seen, frontier = seen.unionByName(new), new
    return seen
