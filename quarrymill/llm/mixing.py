"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

Each source's documents form blocks of ``block_docs``. Weights are rounded to ``a/period`` slots (every source at least
one, largest remainders first). Block i (from 0) of a source is released at slot ``floor(i * period / a)`` and due by
``ceil((i + 1) * period / a)``; earliest-deadline-first among released blocks fills the slots, so at any slot each source
is less than one block off its weight. Counts are whole at the end of a period, so the schedule of one period, which a
fold over its slots makes, repeats; a block's slot follows from its number alone. When a source ends, its slots lapse
and the others keep their proportions: no document is dropped or repeated.

Documents are numbered within their source by salted parts (row numbers within a part, plus the sizes of the parts
before it), so no task holds a whole source. What is broadcast is the period's table, period x sources integers, and a row for each
source. With more sources than slots, sources of equal weight share a class: the class is scheduled like one source and
its members take its blocks in turns, which keeps each within its own bounds. The table is then period x classes
integers (as many as there are distinct weights), and positions come from sums over ranges of slots. So the order differs between as
many sources as slots (each has slots of its own in the period) and one more (equal weights take turns, a turn being as many periods as the
class has members); the bounds and the rows are the same.

Defined cases: a null source is a source of its own; null doc_ids go first in their part; repeated rows each get a
place; empty tables give empty results; null or empty texts are mixed like others; where the weights of all sources present are zero
they count as equal; negative or infinite weights are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 1000
BLOCK_DOCS = 4
#: Documents in a salted part, about.
PART_DOCS = 1024
#: Documents in a range of slots, about, where positions are summed by range.
RANGE_DOCS = 100_000


def weighted(docs: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """(source, n_docs, w): a row per source. weights None: equal weights; sources without one have weight 0. The caller's weights are a
    table that is joined, of any length."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        return counts.withColumn("w", F.lit(1.0))
    if any(not 0 <= v < float("inf") for v in weights.values()):
        raise ValueError("weights must be finite and not negative")
    table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k_ string, w_ double")
    return counts.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("k_")), "left").select("source", "n_docs", F.coalesce("w_", F.lit(0.0)).alias("w"))


def shares(docs: DataFrame, weights: dict[str | None, float] | None, period: int) -> DataFrame:
    """(source, n_docs, slots): slots of the period that each source gets, for at most so many sources as slots."""
    return slotted(weighted(docs, weights), period)


def slotted(t: DataFrame, period: int) -> DataFrame:
    """(source, n_docs, slots) from (source, n_docs, w): at least one slot each, period slots in all."""
    whole = Window.partitionBy(F.lit(1))  # one row per source
    t = t.withColumn("w", F.when(F.sum("w").over(whole) > 0, F.col("w")).otherwise(F.lit(1.0)))
    t = t.withColumn("ideal", F.col("w") * period / F.sum("w").over(whole)).withColumn("low", F.greatest(F.lit(1), F.floor("ideal").cast("int")))
    t = t.withColumn("left", period - F.sum("low").over(whole))
    t = t.withColumn("rank", F.row_number().over(whole.orderBy((F.col("ideal") - F.col("low")).desc(), F.col("source").asc_nulls_first())))
    # left below zero can only come from sources lifted to one slot; all then have one, and the others are dealt by what weights give beyond it
    t = t.withColumn("more", F.greatest(F.lit(0.0), F.col("ideal") - 1)).withColumn("free", period - F.count(F.lit(1)).over(whole))
    t = t.withColumn("more", F.when(F.col("left") < 0, F.col("more") * F.col("free") / F.nullif(F.sum("more").over(whole), F.lit(0.0))).otherwise(0.0)).withColumn("whole", F.floor("more").cast("int"))
    t = t.withColumn("odd", F.col("free") - F.sum("whole").over(whole)).withColumn("odd_rank", F.row_number().over(whole.orderBy((F.col("more") - F.col("whole")).desc(), F.col("source").asc_nulls_first())))
    ample = F.col("low") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)
    scarce = 1 + F.col("whole") + F.when(F.col("odd_rank") <= F.col("odd"), 1).otherwise(0)
    return t.select("source", "n_docs", F.when(F.col("left") < 0, scarce).otherwise(ample).cast("int").alias("slots"))


def schedule(share: DataFrame, period: int) -> DataFrame:
    """(source, slots, occ, slot, before, all_slots, all_docs): the slot in the period of each source's occ-th block, and all
    sources' counts before that slot, with their slots and documents in the same order."""
    one = share.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "slots", "n_docs"))).alias("s")).filter(F.size("s") > 0)
    a = F.transform("s", lambda x: x["slots"])
    one = one.select("s", a.alias("a"))

    def step(st: Column, t: Column) -> Column:
        def due(x: Column, i: Column) -> Column:
            n = st["c"][i]
            release = F.floor(n * period / x)
            return F.when(release <= t, F.struct(F.ceil((n + 1) * period / x).alias("deadline"), i.alias("i")))

        pick = F.array_min(F.transform(F.col("a"), due))["i"]

        def place(p: Column) -> Column:
            return F.struct(
                F.transform(st["c"], lambda v, i: v + F.when(i == p, 1).otherwise(0)).alias("c"),
                F.concat(st["o"], F.array(F.struct(p.alias("i"), st["c"].alias("before")))).alias("o"),
            )

        return F.transform(F.array(pick), place)[0]

    first = F.struct(F.transform("a", lambda x: F.lit(0)).alias("c"), F.array().cast("array<struct<i:int,before:array<int>>>").alias("o"))
    filled = one.select("s", "a", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), first, step, lambda st: st["o"]).alias("o"))
    rows = filled.select("s", "a", F.posexplode("o").alias("slot", "x"))
    mine = F.col("s")[F.col("x.i")]
    return rows.select(
        mine["source"].alias("source"), mine["slots"].alias("slots"), F.col("x.before")[F.col("x.i")].alias("occ"), "slot",
        F.col("x.before").alias("before"), F.col("a").alias("all_slots"), F.transform("s", lambda x: x["n_docs"]).alias("all_docs"),
    )


def numbered(docs: DataFrame, n_parts: int) -> DataFrame:
    """row_ (the whole row), source, rn_: the number (from 0) of each document in its source. The parts go by a digest of the id, which
    also shuffles the source. The window and the join use one key without nulls, so rows move once."""
    tie = F.md5(F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit("")
    part = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(n_parts)).cast("int")
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), "source", name.alias("name_"), F.col("doc_id").alias("id_"), tie.alias("tie_"), part.alias("part_"))
    sizes = docs.select(name.alias("name_"), part.alias("part_")).groupBy("name_", "part_").agg(F.count(F.lit(1)).alias("n_"))
    # sizes of the parts before a part: within its thousand, and of the thousands before it
    sizes = sizes.withColumn("g_", F.floor(F.col("part_") / 1000)).withColumn("in_", F.sum("n_").over(Window.partitionBy("name_", "g_").orderBy("part_")) - F.col("n_"))
    groups = sizes.groupBy("name_", "g_").agg(F.sum("n_").alias("gn_"))
    groups = groups.select("name_", "g_", (F.sum("gn_").over(Window.partitionBy("name_").orderBy("g_")) - F.col("gn_")).alias("up_"))
    before = sizes.join(groups, ["name_", "g_"]).select("name_", "part_", (F.col("in_") + F.col("up_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("name_", "part_").orderBy(F.col("id_").asc_nulls_first(), "tie_")) - 1
    t = t.withColumn("own_", own).join(before, ["name_", "part_"])
    return t.select("row_", "source", (F.col("own_") + F.col("before_")).alias("rn_"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None, period: int, block_docs: int, part_docs: int) -> DataFrame:
    """row_ and its place: block, slot, release, deadline, position."""
    held = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_")).agg(F.coalesce(F.sum("n_"), F.lit(0)), F.count(F.lit(1))).first()
    n, n_sources = int(held[0]), int(held[1])
    if n_sources > period:
        return _placed_by_class(docs, weights, period, block_docs, part_docs, n)
    share = shares(docs, weights, period)
    table = F.broadcast(schedule(share, period).withColumnRenamed("source", "k_"))  # period rows of (3 x sources + 4) integers
    a_of = F.broadcast(share.select(F.col("source").alias("j_"), F.col("slots").alias("a_")))  # a row per source
    t = numbered(docs, max(1, -(-n // part_docs))).withColumn("block", F.floor(F.col("rn_") / block_docs))
    t = t.join(a_of, F.col("source").eqNullSafe(F.col("j_"))).withColumn("q_", F.floor(F.col("block") / F.col("a_"))).withColumn("occ_", F.col("block") % F.col("a_"))
    t = t.join(table, F.col("source").eqNullSafe(F.col("k_")) & (F.col("occ_") == F.col("occ")))
    ahead = F.zip_with(F.zip_with("before", "all_slots", lambda b, a: F.lit(block_docs) * (b + F.col("q_") * a)), "all_docs", lambda x, m: F.least(x, m))
    return t.select(
        "row_", F.col("block").cast("long").alias("block"), (F.col("q_") * period + F.col("slot")).cast("long").alias("slot"),
        F.floor(F.col("block") * period / F.col("a_")).cast("long").alias("release"), F.ceil((F.col("block") + 1) * period / F.col("a_")).cast("long").alias("deadline"),
        (F.aggregate(ahead, F.lit(0).cast("long"), lambda s, x: s + x) + F.col("rn_") % block_docs).cast("long").alias("position"),
    )


def _placed_by_class(docs: DataFrame, weights: dict[str | None, float] | None, period: int, block_docs: int, part_docs: int, n: int) -> DataFrame:
    """:func:`placed` for more sources than slots. Block b of a class's member r of m is the class's block b * m + r."""
    period = max(period, 1 + len(weights or {}))  # a slot at least for each distinct weight
    every = weighted(docs, weights)
    classes = every.groupBy(F.col("w").cast("string").alias("source")).agg(F.sum("n_docs").alias("n_docs"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("m_"))
    share = slotted(classes.drop("m_"), period)
    table = F.broadcast(schedule(share, period).select(F.col("source").alias("k_"), "occ", "slot"))
    member = every.select(F.col("source").alias("name_"), F.col("w").cast("string").alias("source"), (F.row_number().over(Window.partitionBy("w").orderBy(F.col("source").asc_nulls_first())) - 1).alias("r_"))
    member = member.join(F.broadcast(classes.select("source", "m_").join(share, "source")), "source").select(F.col("name_").alias("j_"), F.col("source").alias("class_"), "r_", "m_", F.col("slots").alias("a_"))
    t = numbered(docs, max(1, -(-n // part_docs))).withColumn("block", F.floor(F.col("rn_") / block_docs))
    t = t.join(F.broadcast(member), F.col("source").eqNullSafe(F.col("j_"))).withColumn("of_", F.col("block") * F.col("m_") + F.col("r_"))
    t = t.withColumn("q_", F.floor(F.col("of_") / F.col("a_"))).withColumn("occ_", F.col("of_") % F.col("a_"))
    t = t.join(table, (F.col("class_") == F.col("k_")) & (F.col("occ_") == F.col("occ")))
    turn = F.col("m_") * period
    t = t.select(
        "row_", F.col("block").cast("long").alias("block"), (F.col("q_") * period + F.col("slot")).cast("long").alias("slot"),
        F.floor(F.col("block") * turn / F.col("a_")).cast("long").alias("release"), F.ceil((F.col("block") + 1) * turn / F.col("a_")).cast("long").alias("deadline"), "rn_",
    )
    # ranges of slots with about RANGE_DOCS documents: the documents before a range, and numbers within it
    n_cuts = max(1, n // RANGE_DOCS)
    cuts = t.agg(F.percentile_approx("slot", [i / n_cuts for i in range(1, n_cuts)] or [1.0], 10 * n_cuts + 1000)).first()[0]
    t = t.withColumn("g_", F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("slot"))))
    sizes = t.groupBy("g_").agg(F.count(F.lit(1)).alias("gn_"))
    up = sizes.select("g_", (F.sum("gn_").over(Window.partitionBy(F.lit(1)).orderBy("g_")) - F.col("gn_")).alias("up_"))  # a row a range
    t = t.withColumn("in_", F.row_number().over(Window.partitionBy("g_").orderBy("slot", "rn_")) - 1).join(F.broadcast(up), "g_")
    return t.select("row_", "block", "slot", "release", "deadline", (F.col("in_") + F.col("up_")).cast("long").alias("position"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS, part_docs: int = PART_DOCS) -> DataFrame:
    """The rows of docs with block, slot, release, deadline and position, the place of each in the mixed order; columns of docs with
    one of these names give way."""
    own = ("block", "slot", "release", "deadline", "position")
    return placed(docs, weights, period, block_docs, part_docs).select(*[F.col(f"row_.`{c}`") for c in docs.columns if c not in own], *own)


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS, part_docs: int = PART_DOCS) -> DataFrame:
    """The documents, with all their columns, in the mixed order: a range-partitioned sort by position."""
    return placed(docs, weights, period, block_docs, part_docs).orderBy("position").select("row_.*")
