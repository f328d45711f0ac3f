"""The size of what Python workers are handed: a batch of rows is whole in a worker, with all that is made of it, so it is kept small whatever the table's size."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Rows and bytes of an Arrow batch, at most.
ROWS, BYTES = 200, "4m"


def bounded(spark: SparkSession) -> None:
    """Batches of at most ROWS rows (fewer, where the session says so) and about BYTES, for this session's plans that run from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < held <= ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
