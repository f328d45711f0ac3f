"""Texts in batches: one row holds some megabytes of texts, compressed together, so that passes over the corpus can be repeated from
a written table and answers of a shuffle can be addressed to a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import pack
from .flat import tidy


def squeeze(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; small for sorted differences and for small values."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if len(x) else b""


def spread(blob: bytes, kind: type) -> np.ndarray:
    """The integers of :func:`squeeze`."""
    import zstandard

    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def batched(nodes: DataFrame, batch_bytes: int) -> DataFrame:
    """(k, rep, copies, text) to batches (bid, ks, reps, copies, z). bid is the task's number and a count, so it is unique in a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number, task = 0, 0, TaskContext.get().partitionId()
        tidy()

        def close() -> pa.RecordBatch:
            ks, reps, copies, texts = (list(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number], pa.int64()), pa.array([ks], pa.list_(pa.string())), pa.array([reps], pa.list_(pa.int64())), pa.array([copies], pa.list_(pa.int64())), pa.array([pack(texts)], pa.binary())],
                names=["bid", "ks", "reps", "copies", "z"],
            )

        for b in batches:
            for k, rep, n, text in zip(*(b.column(c).to_pylist() for c in ("k", "rep", "copies", "text")), strict=True):
                raw = text.encode()
                if held and (size + len(raw) > batch_bytes or len(held) >= 60_000):
                    yield close()
                    held, size, number = [], 0, number + 1
                    tidy()
                held.append((k, rep, n, raw))
                size += len(raw)
        if held:
            yield close()

    return nodes.select("k", "rep", "copies", "text").mapInArrow(run, "bid long, ks array<string>, reps array<long>, copies array<long>, z binary")
