"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash at a byte is the sum of table values of the last 32 bytes, each shifted left by its distance, so a cut
depends on the 32 bytes before it alone and an insertion moves only the cuts next to it. Chunks end where the top bits
of the hash are 0, between ``LEAST`` and ``MOST`` bytes. Chunks are grouped over the corpus by a 128-bit digest; the first
occurrence (smallest doc_id, then digest of the text, then offset) stays, later ones are removed. A removed run shorter than
``SPAN`` bytes is kept after all, so that short phrases that texts happen to share stay whole.

Texts that are equal form a node, written once in batches. A batch sends each distinct digest once, packed, with the first of its
nodes that has it; the digest's part tells each batch whether an earlier node elsewhere has the chunk; the batch then cuts its texts.
A passage in a third of all documents is thus one entry a batch.

Defined cases: null and empty texts have no chunks and nothing removed; of equal texts the row with the smallest doc_id stays and
the others lose all of it if they have ``SPAN`` bytes (rows equal in both: all but one); null doc_ids come first in the order;
empty tables give empty results; further columns are ignored. Texts are used whole, and a cut never splits a UTF-8 character.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import unpack
from .flat import byte_table, tidy
from .shared import bounded, partitions, written
from .texts import batched, spread, squeeze

LEAST, MOST, BITS = 16, 64, 4
#: A removed run has at least so many bytes.
SPAN = 64
BATCH_BYTES = 1_000_000
#: Chunks of a part, about.
PART_CHUNKS = 1_000_000


def gear(data: np.ndarray) -> np.ndarray:
    """32-bit gear hash at each byte, by doubling."""
    h = (byte_table(7) >> np.uint64(32)).astype(np.uint32)[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s].copy() << np.uint32(s)
    return h


def ends_of(marks: list[int], size: int) -> list[int]:
    """Chunk ends of one text from the offsets where the hash allows a cut."""
    out, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while size - last > MOST:
        last += MOST
        out.append(last)
    if size > last:
        out.append(size)
    return out


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """(document, start, end, digest) of all chunks of a slice of documents."""
    h = gear(data) if len(data) else np.zeros(0, np.uint32)
    cut = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    cut = cut[cut < len(data)]
    cut = cut[(data[cut] & 0xC0) != 0x80]
    blob = data.tobytes()
    doc, start, end, digest = [], [], [], []
    at = np.searchsorted(cut, offs)
    for d in range(len(offs) - 1):
        base, size = int(offs[d]), int(offs[d + 1] - offs[d])
        # the hash before the 32nd byte of a text also sees the text before it
        marks = [m for m in (cut[at[d] : at[d + 1]] - base).tolist() if m >= 32]
        last = 0
        for e in ends_of(marks, size):
            while e < size and blob[base + e] & 0xC0 == 0x80:
                e -= 1
            if e <= last:
                continue
            doc.append(d)
            start.append(last)
            end.append(e)
            digest.append(hashlib.blake2b(blob[base + last : base + e], digest_size=16).digest())
            last = e
    return doc, start, end, digest


def _chunked(z: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(texts, document, end, digests as two 64-bit words) of a batch."""
    texts = unpack(z)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    doc, _, end, digest = chunks(np.frombuffer(b"".join(texts), np.uint8), offs)
    return texts, np.array(doc, np.int64), np.array(end, np.int64), np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)


def _first_nodes(doc: np.ndarray, digest: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): chunks by digest, then by the place of their node, then by offset; heads begin a digest."""
    order = np.lexsort((np.arange(len(doc)), place[doc], digest[:, 1], digest[:, 0])) if len(doc) else np.zeros(0, np.int64)
    d = digest[order]
    heads = np.flatnonzero(np.append(True, (d[1:] != d[:-1]).any(1))) if len(d) else np.zeros(0, np.int64)
    return order, heads


def _place(ks: list[str], reps: list[int | None]) -> np.ndarray:
    """Rank of each node of a batch in the corpus-wide order of nodes."""
    rank = sorted(range(len(ks)), key=lambda i: (reps[i] is not None, reps[i] or 0, ks[i]))
    out = np.zeros(len(ks), np.int64)
    out[rank] = np.arange(len(ks))
    return out


def decisions(table: DataFrame, bits: int) -> DataFrame:
    """(bid, part, late): for the batch's distinct digests of the part, 1 where a node of another batch comes first."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bid, ks, reps, z in zip(*(b.column(c).to_pylist() for c in ("bid", "ks", "reps", "z")), strict=True):
                _, doc, _, digest = _chunked(z)
                order, heads = _first_nodes(doc, digest, _place(ks, reps))
                d, who = digest[order[heads]], doc[order[heads]]
                part = (d[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(d), np.int64)
                x = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                y = np.append(x[1:], len(part))
                # a null id counts as the least; nodes of one id are told apart by their digest's first 60 bits
                ids = np.array([np.iinfo(np.int64).min if r is None else r for r in reps], np.int64)[who]
                tie = np.array([int(k[:15], 16) for k in ks], np.int64)[who]
                cols = [[squeeze(v[i:j]) for i, j in zip(x, y, strict=True)] for v in (d[:, 0], d[:, 1], ids, tie)]
                cols[0] = [squeeze(np.diff(d[i:j, 0], prepend=np.uint64(0))) for i, j in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([bid] * len(x), pa.int64()), pa.array(part[x], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["bid", "part", "d0", "d1", "ids", "tie"])
                tidy()

    def judge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bids, cols = [], [[], [], [], []]
        for b in batches:
            bids += b.column("bid").to_pylist()
            cols[0] += [np.cumsum(spread(x, np.uint64), dtype=np.uint64) for x in b.column("d0").to_pylist()]
            for to, name, kind in zip(cols[1:], ("d1", "ids", "tie"), (np.uint64, np.int64, np.int64), strict=True):
                to += [spread(x, kind) for x in b.column(name).to_pylist()]
        size = [len(x) for x in cols[0]]
        d0, d1, ids, tie = (np.concatenate(c) for c in cols)
        order = np.lexsort((tie, ids, d1, d0))
        late = np.zeros(len(d0), np.uint8)
        late[order[1:]] = (d0[order[1:]] == d0[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]])
        cuts = np.cumsum([0, *size])
        for i in range(0, len(bids), 256):
            j = min(len(bids), i + 256)
            yield pa.RecordBatch.from_arrays([pa.array(bids[i:j], pa.int64()), pa.array([key[0].as_py()] * (j - i), pa.int64()), pa.array([squeeze(late[cuts[x] : cuts[x + 1]]) for x in range(i, j)], pa.binary())], names=["bid", "part", "late"])

    asked = table.select("bid", "ks", "reps", "z").mapInArrow(ask, "bid long, part long, d0 binary, d1 binary, ids binary, tie binary")
    return asked.groupBy("part").applyInArrow(judge, "bid long, part long, late binary")


def spans(ends: list[int], gone: list[int], least: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs of removed chunks of at least so many bytes."""
    out: list[list[int]] = []
    for g in gone:
        a, b = (ends[g - 1] if g else 0), ends[g]
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def cut(table: DataFrame, late: DataFrame) -> DataFrame:
    """A row a node: k, rep, copies, n_bytes, n_chunks, n_repeated, n_removed, spans, kept_sha256, kept_text."""
    names = ["k", "rep", "copies", "n_bytes", "n_chunks", "n_repeated", "n_removed", "spans", "kept_sha256", "kept_text"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        told = sorted(zip(right.column("part").to_pylist(), right.column("late").to_pylist(), strict=True))
        flags = np.concatenate([spread(x, np.uint8) for _, x in told] or [np.zeros(0, np.uint8)])
        for ks, reps, copies, z in zip(*(left.column(c).to_pylist() for c in ("ks", "reps", "copies", "z")), strict=True):
            texts, doc, end, digest = _chunked(z)
            order, heads = _first_nodes(doc, digest, _place(ks, reps))
            gone = np.ones(len(doc), bool)
            gone[order[heads]] = flags > 0
            cuts = np.searchsorted(doc, np.arange(len(ks) + 1))
            for i, (k, rep, raw) in enumerate(zip(ks, reps, texts, strict=True)):
                x, y = cuts[i], cuts[i + 1]
                g = np.flatnonzero(gone[x:y]).tolist()
                out = spans(end[x:y].tolist(), g)
                kept, last = [], 0
                for p, q in out:
                    kept.append(raw[last:p])
                    last = q
                whole = b"".join([*kept, raw[last:]])
                for to, v in zip(rows, (k, rep, copies[i], len(raw), int(y - x), len(g), len(raw) - len(whole), ",".join(f"{p}:{q}" for p, q in out), hashlib.sha256(whole).hexdigest(), whole.decode()), strict=True):
                    to.append(v)
        tidy()
        kinds = [pa.string(), *[pa.int64()] * 6, *[pa.string()] * 3]
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

    spec = "k string, rep long, copies long, n_bytes long, n_chunks long, n_repeated long, n_removed long, spans string, kept_sha256 string, kept_text string"
    return table.groupBy("bid").cogroup(late.groupBy("bid")).applyInArrow(run, spec)


def dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated (chunks that occur earlier), n_removed (bytes), spans (start:end in bytes), kept_sha256, kept_text."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.md5(text).alias("k"), text.alias("text"))
    # min() skips null: a node with a null id takes null, the first of the order
    rep = F.when(F.count("doc_id") == F.count(F.lit(1)), F.min("doc_id"))
    nodes = keyed.groupBy("k").agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    table = written(batched(nodes, batch_bytes), "texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(math.ceil(math.log2(max(1, int(size) / 64 / PART_CHUNKS))), math.ceil(math.log2(max(1, partitions(docs.sparkSession)))))
    done = written(cut(table, decisions(table, bits)), "cut")
    cols = ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "spans", "kept_sha256", "kept_text"]
    own = done.select(F.col("rep").alias("doc_id"), *cols[1:])
    # further rows of a node lose the whole text, if it is long enough; only what they need of it moves
    long = F.col("n_bytes") >= SPAN
    few = done.filter("copies > 1").select("k", "rep", "n_bytes", "n_chunks", F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(long, "").otherwise(F.col("kept_text")).alias("kept_text"))
    each = keyed.groupBy("k", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    lost = each.join(few, "k").withColumn("n", F.col("n") - F.when(F.col("doc_id").eqNullSafe(F.col("rep")), 1).otherwise(0)).filter("n > 0")
    lost = lost.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "doc_id", "n_bytes", "n_chunks", F.col("n_chunks").alias("n_repeated"), F.when(long, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(long, F.concat(F.lit("0:"), F.col("n_bytes"))).otherwise("").alias("spans"), "kept_sha256", "kept_text",
    )
    return own.unionByName(lost)
