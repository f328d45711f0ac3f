"""Cutting lineage in loops: an eager checkpoint in the folder that the cluster names, a folder of our own only where none is named and all is one process."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="quarrymill-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return df.checkpoint(eager=True)
