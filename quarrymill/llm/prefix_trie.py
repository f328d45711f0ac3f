"""Prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

Construction is level-synchronous. At each depth the live conversations, those whose node may still branch, are grouped by (parent node,
next turn); a group is a node and takes the smallest conv_id of its members as its name. A node whose members all go on alike (or that has
one member) is settled: its chain down to the leaf follows from one member's turns, so conversations leave the loop as soon as nothing can
branch, and levels end with the longest opening that is shared by conversations that differ later. Reverse joins, level by level, then sum
leaves and savings up to the root.

Texts leave the rows with the first step: a turn is the MD5 of its role and text and its length. Groups are formed in two steps, by a salt of
the conversation and then without it, and names come back by the same salt, so a first turn that a third of all conversations share is
dealt over ``SALTS`` tasks. Whether members go on alike is decided by 128 bits over (position, turn) of all that follows.

Defined cases: null role and null text are empty; null turns come first; turns of one number are ordered by their digest, repeated rows are
turns of their own; rows without conv_id belong to no conversation and are left out; a conversation without turns is a member of the root
alone; an empty table has no nodes; further columns are ignored. Texts are used whole. The turns of one conversation are numbered by one
task, which sorts them outside memory if they are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, partitions, written, written_small

SALTS = 32
#: Ids in a packed row.
PACK = 8192
#: Conversations to a block with a common base, and turns that may come from it.
BLOCK, MOST = 100, 5

ENDS = "depth long, head long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, key, chars): the turns of every conversation in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    return rows.select("conv", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "key")).cast("long").alias("pos"), "key", "chars")


def spliced(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as the contract rebuilds them, (conv) and their turns: the first h turns of the block's base, then those of one's own after the first h."""
    h = F.crc32(F.col("conv").cast("string")) % (MOST + 1)
    own = written(own.withColumn("h", h), "turns")
    base = own.filter((F.col("conv") % BLOCK == 0) & (F.col("pos") <= MOST)).groupBy(F.col("conv").alias("base"))
    base = base.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("first"))  # MOST turns at most
    convs = own.filter("pos = 1").select("conv", "h", (F.col("conv") - F.col("conv") % BLOCK).alias("base")).join(base, "base", "left")
    convs = convs.select("conv", F.coalesce(F.filter("first", lambda t: t["pos"] <= F.col("h")), F.array().cast("array<struct<pos:bigint,key:binary,chars:bigint>>")).alias("first"))
    convs = written(convs, "conversations")
    taken = convs.select("conv", F.inline("first"))
    rest = own.filter("pos > h").join(convs.select("conv", F.size("first").alias("k")), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "chars")
    return convs.select("conv"), taken.unionByName(rest)


def remaining(rows: DataFrame) -> DataFrame:
    """Turns with what follows them: last (is it the last one), u and v (digests of all that follows), below (characters from here to the end)."""
    x, y = F.xxhash64("pos", "key"), F.xxhash64("key", "pos")
    w = Window.partitionBy("conv").orderBy(F.desc("pos"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"x": x, "y": y}).select(
        "conv", "pos", "key", "chars", (F.row_number().over(w) == 1).alias("last"), F.bit_xor("x").over(upto).bitwiseXOR(F.col("x")).alias("u"),
        F.bit_xor("y").over(upto).bitwiseXOR(F.col("y")).alias("v"), F.sum("chars").over(upto).alias("below"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (conv, node, key, last, u, v, ...) with the head, size n and settled flag of their group (node, key)."""
    salted = rows.withColumn("salt", F.pmod(F.hash("conv"), F.lit(SALTS)))
    lows = [F.min(c).alias(f"{c}0") for c in ("last", "u", "v")]
    highs = [F.max(c).alias(f"{c}1") for c in ("last", "u", "v")]
    some = salted.groupBy("node", "key", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("head"), *lows, *highs)
    alike: Column = (F.min("last0") == F.max("last1")) & (F.min("u0") == F.max("u1")) & (F.min("v0") == F.max("v1"))
    whole = some.groupBy("node", "key").agg(F.sum("n").alias("n"), F.min("head").alias("head"), alike.alias("settled")).filter("n > 1")
    named = some.select("node", "key", "salt").join(whole, ["node", "key"])
    out = salted.join(named, ["node", "key", "salt"], "left")
    return out.drop("salt").withColumns({"head": F.coalesce("head", "conv"), "n": F.coalesce("n", F.lit(1)), "settled": F.coalesce("settled", F.lit(True))})


def levels(convs: DataFrame, rows: DataFrame) -> tuple[int, int, list[DataFrame]]:
    """(conversations, smallest one, per depth from 1 the live conversations with their node). rows is :func:`remaining`'s written table."""
    n, root = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    live, out, depth = convs.select("conv", F.lit(root).alias("node")), [], 0
    while n:
        depth += 1
        here = rows.filter(F.col("pos") == depth).drop("pos").join(live, "conv")
        held = written(_grouped(here), "level")
        if held.isEmpty():
            break
        out.append(held)
        live = held.filter("NOT settled AND NOT last").select("conv", F.col("head").alias("node"))
    return n, root, out


def digests(ends: DataFrame) -> DataFrame:
    """ends (depth, head, conv) to the SHA-256 of each node's ids in order. Ids are sorted by ranges over all tasks and packed; one task
    then streams the packs of a node through the hash, which has no other order, and holds one pack at a time."""
    bounded(ends.sparkSession, 4096)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, first, ids = ["depth", "head", "at", "ids"], None, 0, []
        for b in batches:
            out = []
            for depth, head, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (node != (depth, head) or len(ids) == PACK):
                    out.append((*node, first, ",".join(ids)))
                    ids = []
                if not ids:
                    node, first = (depth, head), conv
                ids.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, first, ",".join(ids))], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, state = ["depth", "head", "ends_sha256"], None, None
        for b in batches:
            out = []
            for depth, head, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if node == (depth, head):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, head), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=names)

    parts = partitions(ends.sparkSession)
    order = ["depth", "head", "conv"]
    packs = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, head long, at long, ids string")
    return packs.repartition(parts, "depth", "head").sortWithinPartitions("depth", "head", "at").mapInArrow(digest, ENDS)


def build(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every node of the trie: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs (conv) names all conversations; rows (conv, pos from 1 without gaps, key, chars) are their turns, none for an empty conversation.
    """
    rows = written(remaining(rows).sortWithinPartitions("pos"), "turns")
    n, root, held = levels(convs, rows)
    if not n:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def summed(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
        """nodes with what their children hold; nodes have own, their own savings."""
        if below is None:
            return nodes.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.col("own")}).select(*columns)
        up = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        return nodes.join(up, "conv_id", "left").withColumns(
            {"n_children": F.coalesce("c", F.lit(0)), "n_leaves": F.coalesce("l", F.lit(1)), "saved_tokens": F.col("own") + F.coalesce("s", F.lit(0))}
        ).select(*columns)

    done: list[DataFrame] = []
    below = None
    for depth in range(len(held), 0, -1):
        named = held[depth - 1].filter("conv = head").select(F.col("conv").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), "chars", "below", "last", "settled")
        open_ = summed(named.filter("NOT settled").withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), below)
        shut = named.filter("settled").select("conv_id", "depth", "parent_conv_id", "n_convs", (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("below")).alias("saved_tokens"))
        below = written_small(open_.unionByName(shut), "nodes")
        done.append(below)
    spark = convs.sparkSession
    top = spark.createDataFrame([(root, 0, None, n, 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, own long")
    done.append(summed(top, below))

    all_held = [h.withColumn("depth", F.lit(d).cast("long")) for d, h in enumerate(held, 1)]
    some = None
    for h in all_held:
        some = h if some is None else some.unionByName(h)
    ended = convs.join(rows.filter("pos = 1").select("conv"), "conv", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(root).alias("head"), "conv")
    if some is not None:
        # below a settled node follows its chain: the turns of its head
        chain = some.filter("settled AND NOT last AND conv = head").select("conv", "n", F.col("depth").alias("from"))
        chain = rows.join(chain, "conv").filter(F.col("pos") > F.col("from"))
        done.append(chain.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("below")).alias("saved_tokens")))
        length = rows.filter("last").select("conv", F.col("pos").alias("len"))
        stop = some.filter("settled OR last").select("conv", "head")
        ended = ended.unionByName(stop.join(length, "conv").select(F.col("len").alias("depth"), "head", "conv"))
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    said = digests(ended).withColumnRenamed("head", "conv_id")
    return nodes.join(said, ["depth", "conv_id"], "left").select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
