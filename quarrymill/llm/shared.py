"""Helpers of the training-data operators: the shared work folder, written tables, sizing."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or (only where unset, and in one process, as in tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quarrymill-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = _OWN[app]
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; others' tables lie beside it."""
    return f"{shared_dir(spark)}/quarrymill/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application's operators have written in the shared folder; for callers who have stored their results."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` for tables of a few numbers a document (edges, labels): a sixteenth of the session's partitions, as every file
    that an executor creates on a local folder starts a process of its own."""
    return written(df.coalesce(max(1, partitions(df.sparkSession) // 16)), name)


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """Adds the row's place (from 0) in the order in which a table was written: by file, then by row. Rows read from one have their place
    in it; other rows are written first, as they come. Nothing moves: a row a file (how many rows lie before it) is joined."""
    at = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_")]
    try:
        t = docs.select("*", *at)
    except AnalysisException:
        t = written(docs, "as_they_come").select("*", *at)
    files = t.groupBy("file_").agg((F.max("row_") + 1).alias("n_"))
    order = Window.orderBy(F.length("file_"), "file_")  # a row a file; the numbers in names have leading zeros, longer ones follow
    files = files.select("file_", (F.sum("n_").over(order) - F.col("n_")).alias("up_"))
    return t.join(F.broadcast(files), "file_").withColumn(name, F.col("up_") + F.col("row_")).drop("file_", "row_", "up_")


def bounded(spark: SparkSession, rows: int = 1000) -> None:
    """Rows reach Python workers in Arrow batches of at most so many rows and some megabytes, whatever the size of a text or packed row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: float, rows_each: float) -> int:
    """Number of shuffle partitions for so many rows: follows the data, at least the session's setting."""
    return max(partitions(spark), math.ceil(rows / rows_each))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def spare(columns: list[str], *names: str) -> list[str]:
    """Names for further columns that none of these columns has, in either case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out
