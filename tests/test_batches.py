"""Python workers are handed few rows at a time, whatever the size of the table."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import discovery, dom
from quarrymill.sources import structured

N = 3000


@pytest.fixture()
def most(spark, monkeypatch, tmp_path):
    """The most rows of a batch that a plan of the library's gets; the session's own bound is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, "10000")
    yield lambda: max(r["n"] for r in spark.range(0, N, 1, 1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").collect())
    spark.conf.set(key, held)


@pytest.mark.parametrize(
    "plan",
    [
        lambda t: dom.surfaces(t, "file", "text"), lambda t: dom.elements(t, "file", "text"), lambda t: dom.map_text(t, "text", str.upper), structured.front_matter, structured.markdown_lines,
        lambda t: t.select(discovery.folded(F.col("text"))),
    ],
)
def test_batches_are_small(spark, most, plan):
    t = spark.range(0, N, 1, 1).select(F.col("id").cast("string").alias("file"), F.lit("---\na: b\n---\n").alias("text"))
    assert most() == N
    got = plan(t)
    assert most() <= 200
    assert got.count() >= N or got.columns[0] == "key"
