"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written_small

SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest node it reaches.

    Each round takes the smallest label around every node, then that label's own label, so a path shortens by more than half;
    labels are tables in the shared folder. Stars, the common form here, take two rounds. Only a changed-or-not flag reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written_small(both, "edges")
    lab = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    lab = written_small(lab, "labels")
    while True:
        near = both.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = lab.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # labels that have a smaller label themselves: few, and each in SALTS parts, as all of a component may share a label
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("further")).filter("further <> label")
        hop = roots.join(step.select("label").distinct(), "label", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = step.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS)))
        new = written_small(salted.join(hop, ["label", "salt"], "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        done = new.filter(F.col("old") != F.col("label")).isEmpty()
        lab = new.select("node", "label")
        if done:
            return lab
