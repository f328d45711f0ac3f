"""Where everything of a build comes from, both ways: source entity, content entry, route, output.

One table of labelled edges (id, label, value, rank) holds what the manifest, the inventory and the content say of an entity. What content says
precedes what the manifest says, by an ordered aggregate over the edges; an entity's many routes stay rows. Lookups start at any label
and are joins, so a list of subjects takes one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

# What an entity has one of, and what it may have many of.
ONE = ("origin", "source", "collection", "locale", "declared_by", "expected_route")
MANY = ("route", "output")
UNSTATED = "unstated"
#: Ranks of who says it: content precedes the manifest.
CONTENT, MANIFEST = 0, 1


def edges(intended: DataFrame, inventory: DataFrame, claims: DataFrame) -> DataFrame:
    """id, label, value, rank, pos. intended: id, origin, source, collection, locale, declared_by, expected_route (the manifest's rows); inventory: path,
    file, entry (id or null); claims: id, origin, source, collection, locale, declared_by, pos (what content says; the last of an id counts).

    An entity has a node edge, so that one of which nothing is said is there too. Claims and routes of entities that are not intended are left out
    by :func:`lineage`, and found by lookups.
    """
    none = F.lit(None).cast("long")
    said = lambda d, names, rank, pos: d.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("string").alias("value")) for n in names])).alias("e"), F.lit(rank).alias("rank"), pos.alias("pos")).select("id", "e.label", "e.value", "rank", "pos")
    node = intended.select("id", F.lit("node").alias("label"), F.lit("").alias("value"), F.lit(MANIFEST).alias("rank"), none.alias("pos"))
    own = said(claims, ONE[:-1], CONTENT, F.col("pos").cast("long"))
    rows = inventory.filter("entry is not null").select(F.col("entry").alias("id"), U.trim_slashes(F.col("path")).alias("route"), F.regexp_replace("file", "^/+", "").alias("output"))
    return node.unionByName(said(intended, ONE, MANIFEST, none)).unionByName(own).unionByName(said(rows, MANY, MANIFEST, none))


def _first(label: str) -> Column:
    """What is said of a label: all that content says precedes the manifest, null too, as a claim replaces the manifest's row; its last claim counts."""
    return F.min_by(F.struct(F.col("value").alias("v")), F.when(F.col("label") == label, F.struct("rank", (-F.coalesce("pos", F.lit(0))).alias("p"))))["v"].alias(label)


def lineage(e: DataFrame) -> DataFrame:
    """id, origin, source, collection, locale, declared_by, expected_route, n_routes, route, output, withheld: a row an intended entity; route and output
    are the first of theirs, all of them are edges."""
    n = F.count_if(F.col("label") == "route")
    first = lambda label: F.min(F.when(F.col("label") == label, F.col("value"))).alias(label)
    t = e.groupBy("id").agg(*[_first(x) for x in ONE], n.alias("n_routes"), first("route"), first("output"), F.bool_or(F.col("label") == "node").alias("node"))
    return t.filter("node").select("id", F.coalesce("origin", F.lit(UNSTATED)).alias("origin"), *ONE[1:], "n_routes", "route", "output", (F.col("n_routes") == 0).alias("withheld"))


def lookup(e: DataFrame, label: str, subjects: DataFrame) -> DataFrame:
    """subject, id: which intended entities a route, an output or a source entity belongs to. subjects: subject. A route or output has one entity, the
    last by id where several claim it; a source has all that claim it. Subjects that nothing has come with a null id."""
    key = {"route": U.trim_slashes(F.col("subject")), "output": F.regexp_replace("subject", "^/+", "")}.get(label, F.col("subject"))
    if label == "source":
        held = lineage(e).select("id", F.col("source").alias("value"))
    else:
        known = e.filter("label = 'node'").select("id").distinct()
        held = e.filter(F.col("label") == label).join(known, "id", "left_semi").groupBy("value").agg(F.max("id").alias("id"))
    return subjects.select("subject", key.alias("value")).join(held.filter("value is not null"), "value", "left").select("subject", "id")


def summary(lines: DataFrame) -> DataFrame:
    """One row: entities, wordpress, derived, published, withheld."""
    n = lambda c, a: F.count_if(c).alias(a)
    return lines.agg(F.count(F.lit(1)).alias("entities"), n(F.col("origin") == "wordpress", "wordpress"), n(F.col("origin") == "derived", "derived"), n(~F.col("withheld"), "published"), n(F.col("withheld"), "withheld"))
