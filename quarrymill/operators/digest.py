"""Render digests compared: lines as bags by label, boxes matched first fit within a tolerance, routes sampled by template.

A line is ``label | geometry | painted | text``. Lines of a file are grouped by everything but their geometry; within a group every recorded line takes
the first free built line, in the digest's order, whose numbers all lie within the tolerance. A grid finds it: boxes lie in cells as wide as the
tolerance reaches, so a line looks into its cell and the neighbours, not through the whole group. Files whose texts are equal have no
difference and are left out before anything moves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ordering import evenly_spaced

# Pixels by which a box may differ, routes recorded of a template.
TOLERANCE, SAMPLE = 1, 6
#: Between a label and the rest of its key; no digest line has it.
APART = "␟"
#: Numbers of a box that place it in the grid.
AXES = 2


def first_fit(a: list[tuple[int, ...] | None], b: list[tuple[int, ...] | None], within: int = TOLERANCE) -> tuple[list[int], list[int]]:
    """(places of a that found nothing, places of b that are left): each of a in turn takes the first free one of b with as many numbers, none of
    them further off than the tolerance. No numbers (None) fit no numbers."""
    cells: dict[tuple, list[int]] = defaultdict(list)

    def cell(x: tuple[int, ...] | None) -> tuple:
        return (-1,) if x is None else (len(x), *(v // (within + 1) for v in x[:AXES]))

    for i, y in enumerate(b):
        cells[cell(y)].append(i)
    taken, heads, lost = [False] * len(b), defaultdict(int), []

    def free(c: tuple) -> Iterator[int]:
        held = cells[c]
        while heads[c] < len(held) and taken[held[heads[c]]]:
            heads[c] += 1
        return (i for i in held[heads[c] :] if not taken[i])

    for i, x in enumerate(a):
        own = cell(x)
        near = [own] if x is None else [(own[0], *(p + q for p, q in zip(own[1:], step, strict=True))) for step in product((-1, 0, 1), repeat=len(own) - 1)]
        for j in merge(*(free(c) for c in near if c in cells)):
            y = b[j]
            if x is None or all(abs(p - q) <= within for p, q in zip(x, y, strict=True)):
                taken[j] = True
                break
        else:
            lost.append(i)
    return lost, [j for j, t in enumerate(taken) if not t]


def lines(digests: DataFrame) -> DataFrame:
    """file, pos, line, key, numbers of digests (file, text); empty lines are none, numbers are null without any."""
    t = digests.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).filter("line <> ''")
    parts = F.split("line", " \\| ", -1)
    numbers = F.transform(F.regexp_extract_all(F.get(parts, F.lit(1)), F.lit("(-?[0-9]+)"), 1), lambda x: x.cast("long"))
    key = F.when(F.size(parts) < 2, F.col("line")).otherwise(F.concat(parts[0], F.lit(APART), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), " | ")))
    return t.select("file", "pos", "line", key.alias("key"), F.when(F.size(numbers) > 0, numbers).alias("numbers"))


def differences(recorded: DataFrame, built: DataFrame, within: int = TOLERANCE) -> DataFrame:
    """file, side (removed, added), line of files that both sides have (file, text, a row a file)."""
    both = recorded.select("file", F.col("text").alias("old")).join(built.select("file", F.col("text").alias("new")), "file").filter(~F.col("old").eqNullSafe(F.col("new")))
    t = lines(both.select("file", F.col("old").alias("text"))).withColumn("side", F.lit(0)).unionByName(lines(both.select("file", F.col("new").alias("text"))).withColumn("side", F.lit(1)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        sides = [p[p.side == s] for s in (0, 1)]
        boxes = [[None if v is None else tuple(v) for v in s.numbers] for s in sides]
        lost, left = first_fit(*boxes, within)
        rows = [(p.file.iloc[0], "removed", sides[0].line.iloc[i]) for i in lost] + [(p.file.iloc[0], "added", sides[1].line.iloc[j]) for j in left]
        return pd.DataFrame(rows, columns=["file", "side", "line"])

    return t.groupBy("file", "key").applyInPandas(run, "file string, side string, line string")


def compare(recorded: DataFrame, built: DataFrame, within: int = TOLERANCE) -> DataFrame:
    """file, kind (changed, unrecorded, vanished), removed, added: files that are not as they were recorded, both ways."""
    diff = differences(recorded, built, within).groupBy("file").agg(F.count_if(F.col("side") == "removed").alias("removed"), F.count_if(F.col("side") == "added").alias("added"))
    one = lambda d, kind: d.select("file", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("added"))
    fresh = built.select("file").join(recorded.select("file"), "file", "left_anti")
    gone = recorded.select("file").join(built.select("file"), "file", "left_anti")
    return diff.select("file", F.lit("changed").alias("kind"), "removed", "added").unionByName(one(fresh, "unrecorded")).unionByName(one(gone, "vanished"))


def sampled(routes: DataFrame, k: int = SAMPLE) -> DataFrame:
    """route of the routes to record: of each template k, evenly spaced in the order of routes; those without a template all. routes: route, template."""
    own = routes.filter("template is not null").select("template", "route").distinct()
    return routes.filter("template is null").select("route").distinct().unionByName(evenly_spaced(own, "template", "route", k).select("route")).distinct()


def gate(routes: DataFrame, recorded: DataFrame, built: DataFrame, k: int = SAMPLE, within: int = TOLERANCE) -> DataFrame:
    """:func:`compare` of the sampled routes' digests. routes: route, template, file."""
    routes = cut(routes.select("route", "template", "file"))
    files = routes.join(sampled(routes.select("route", "template"), k), "route", "left_semi").select("file").distinct()
    files = cut(files)
    return compare(recorded.join(files, "file", "left_semi"), built.join(files, "file", "left_semi"), within)
