"""Pagination, samples, outlines, ranks and other computations that need an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

def paginate(items: DataFrame, group: str, order: list[Column], size: int, groups: DataFrame) -> DataFrame:
    """group, page, page_count, total, first, last, has_previous, has_next. groups: all listings; an empty one has one empty page."""
    n = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    t = groups.join(n, group, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    t = t.withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")).withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))))
    return t.select(
        group, "page", "page_count", "total", F.when(F.col("total") == 0, 0).otherwise((F.col("page") - 1) * size + 1).cast("long").alias("first"),
        F.least(F.col("total"), F.col("page") * size).cast("long").alias("last"), (F.col("page") > 1).alias("has_previous"), (F.col("page") < F.col("page_count")).alias("has_next"),
    )


def _placed(df: DataFrame, group: str, order: list) -> DataFrame:
    """Adds i_ (place from 0 in its group) and n_ (the group's size): places in one global order over all tasks, less the group's start, so that
    many tasks sort a hot group. A row a group is joined back; null is a group too."""
    t = numbered(df.withColumn("g_", F.col(group)), [F.col("g_").asc_nulls_first(), *order], "r_")
    starts = t.groupBy(F.col("g_").alias("k_")).agg(F.min("r_").alias("s_"), F.count(F.lit(1)).alias("n_"))
    return t.join(starts, F.col("g_").eqNullSafe(F.col("k_"))).withColumn("i_", F.col("r_") - F.col("s_")).drop("r_", "s_", "k_", "g_")


def page_of(items: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """The items with their page and rank in the listing."""
    t = _placed(items, group, order).withColumn("rank", F.col("i_") + 1).drop("i_", "n_")
    return t.withColumn("page", F.ceil(F.col("rank") / size).cast("long"))


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Adds name: the total of a value over all rows before, in one global order. Rows are dealt by ranges of the order; a row a partition
    (its total) reaches the driver, and no task holds more than its range. Rows that tie in the order are taken as they come."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = cut(df.withColumn("v_", value.cast("long")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()).withColumn("p_", F.shiftright("at_", 33)))
    at, starts = 0, []
    for r in t.groupBy("p_").agg(F.sum("v_").alias("v")).orderBy("p_").collect():
        starts.append((r["p_"], at))
        at += r["v"] or 0
    before = F.coalesce(F.sum("v_").over(Window.partitionBy("p_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(spark.createDataFrame(starts, "p_ long, o_ long"))
    return t.withColumn("b_", before).join(offsets, "p_").withColumn(name, F.col("b_") + F.col("o_")).drop("v_", "at_", "p_", "b_", "o_")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds name: the row's place from 0 in one global order."""
    return running_total(df, order, F.lit(1), name)


def page_window(current: Column, last: Column) -> Column:
    """The page numbers a pager shows: all of up to seven, else the ends and two around the current; 0 stands for a gap."""
    every = F.sequence(F.lit(1), last)
    near = F.filter(every, lambda p: (p == 1) | (p == last) | (F.abs(p - current) <= 2))
    spaced = F.flatten(F.transform(near, lambda p, i: F.when((i > 0) & (p - F.get(near, i - 1) > 1), F.array(F.lit(0), p)).otherwise(F.array(p))))
    return F.when(last <= 7, every).otherwise(spaced)


def evenly_spaced(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group, evenly spaced with both ends; smaller groups whole."""
    t = _placed(df, group, [F.col(order)])
    pick = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("n_") - 1) / F.lit(max(1, k - 1)) + 0.5).cast("long"))
    return t.filter((F.col("n_") <= k) | F.array_contains(pick, F.col("i_")) if k > 1 else F.col("i_") == 0).drop("i_", "n_")


def outline_issues(df: DataFrame, levels: str, at: str) -> DataFrame:
    """at, code, detail of a heading outline given as an array of levels; inside the row, so nothing moves."""
    v = F.col(levels)
    ones = F.size(F.filter(v, lambda x: x == 1))
    skip = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(v, i - 1).alias("p"))), lambda s: (s["i"] > 0) & (s["x"] > s["p"] + 1))
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    found = F.concat(
        F.array_compact(F.array(
            F.when(ones == 0, issue("no-h1", F.lit(""))), F.when(ones > 1, issue("multiple-h1", ones)),
            F.when((F.size(v) > 0) & (v[0] != 1), issue("starts-below-h1", v[0])),
        )),
        F.transform(skip, lambda s: issue("skipped-level", F.concat_ws(">", s["p"].cast("string"), s["x"].cast("string")))),
    )
    return df.select(at, F.explode(found).alias("f")).select(at, "f.code", "f.detail")


def numbered_anchors(df: DataFrame, doc: str, base: str, order: str) -> DataFrame:
    """Adds anchor: the nth repeat of a base in a document gets -n."""
    n = F.row_number().over(Window.partitionBy(doc, base).orderBy(order)) - 1
    return df.withColumn("anchor", F.when(n == 0, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))


def best_by_weight(df: DataFrame, key: str, weight: str, family: str) -> DataFrame:
    """key, family: the family of the heaviest match; exactly post and page tie to entry, other ties to unknown."""
    top = df.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(weight)))).filter("r = 1")
    s = top.groupBy(key).agg(F.array_sort(F.collect_set(family)).alias("s"))
    return s.select(key, F.when(F.size("s") == 1, F.col("s")[0]).when(F.array_join("s", ",") == "page,post", "entry").otherwise("unknown").alias("family"))


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (a report's limit), with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def median_half_up(col: str) -> Column:
    """Median; of two middle values the mean, halves up."""
    return F.floor(F.median(col) + 0.5).cast("long")


def body_report(df: DataFrame, group: str | None = None, fraction: float = 0.2, least: int = 8) -> DataFrame:
    """id, length, builder, reason: bodies under a fraction of the median (from so many bodies on) are short, then those with a builder's marks.

    The median is one aggregate, joined back as one row a group.
    """
    by = [group] if group else []
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("length").alias("m")).withColumn("floor", F.when(F.col("n") < least, 0.0).otherwise(F.floor(F.col("m") + 0.5) * fraction)).select(*by, "floor")
    t = df.join(F.broadcast(stats), group) if group else df.join(F.broadcast(stats))
    return t.withColumn("reason", F.when(F.col("length") < F.col("floor"), "short").when(F.col("builder").isNotNull(), "builder")).drop("floor")


def majority_then_all(df: DataFrame, family: str, page: str, name: str) -> DataFrame:
    """name: values on more than half of the pages of every family. df: a row for each page and name (name null: a page without)."""
    pages = df.groupBy(family).agg(F.countDistinct(page).alias("n"))
    has = df.filter(F.col(name).isNotNull()).groupBy(family, name).agg(F.countDistinct(page).alias("c"))
    most = has.join(pages, family).filter("c * 2 > n")
    total = pages.agg(F.count(F.lit(1)).alias("families"))
    return most.groupBy(name).agg(F.count(F.lit(1)).alias("f")).join(F.broadcast(total), F.col("f") == F.col("families")).select(name)


def enumerated_order(col: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), col)


def bag_difference(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """cols, side, n: rows of one bag that the other lacks, with their number: one aggregate over both."""
    t = a.select(*cols, F.lit(1).alias("d")).unionByName(b.select(*cols, F.lit(-1).alias("d")))
    return t.groupBy(*cols).agg(F.sum("d").alias("n")).filter("n <> 0").select(*cols, F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").cast("long").alias("n"))


def report_lines(rows: DataFrame, group: str, line: str, most: int) -> DataFrame:
    """group, pos, line: a report's first lines of each group in order, and then how many more there are.

    The cut is the feature: counts come from an aggregate over all rows, and lines are kept in two steps, so that no task sorts all
    rows of a hot group."""
    t = rows.select(group, line)
    for by in ([group, F.pmod(F.xxhash64(line), F.lit(64))], [group]):
        t = t.select(group, line).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(line))).filter(F.col("pos") <= most)
    more = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > most)
    more = more.select(group, F.lit(most + 1).alias("pos"), F.concat(F.lit("… and "), (F.col("n_") - most).cast("string"), F.lit(" more")).alias(line))
    return t.select(group, "pos", line).unionByName(more)
