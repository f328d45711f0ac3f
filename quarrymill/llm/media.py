"""Media columns: a Spark data source over directories of archives.

Archives are ZIP files with stored members, so a member is a range of bytes. The source plans byte ranges of the archives
as partitions; a partition reads the members whose headers start in its range, streams their payloads as Arrow batches and
retries each member by its own offset; a member that stays unreadable or fails its checksum fails the task by name.

Payloads are stored as 8-bit grey PNG pictures, 192 samples wide, which is lossless. The media form depends on the payload
alone: equal texts have equal media. Archives are written under names of their own attempt and listed in an index written
last, so a repeated task leaves no members twice.

Defined cases: null text is the empty text (a payload of 192 blanks); repeated rows each have a member; null doc_ids come
back null; an empty table gives an archive directory without archives and an empty result; further columns are ignored.
Texts are stored whole; an archive holds at least one member, however large.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store
from .flat import tidy
from .shared import bounded, fresh_path, written

WIDTH = 192
ARCHIVE_BYTES = 24_000_000
RANGE_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
ATTEMPTS = 4
LEVEL = 2
INDEX = "index.json"
# Fixed value: the signature of PNG files.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes without padding, UTF-8 with blanks up to a positive multiple of WIDTH)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload as an 8-bit grey picture, a row for each WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a picture written by :func:`to_png`; checks every chunk."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width = 8, [], 0
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("PNG chunk fails its checksum")
        if kind == b"IHDR":
            width = struct.unpack(">I", part[:4])[0]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """mean:deviation:shares of sixteen bands of sample values, in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.3f}:{x.std():.3f}:" + ",".join(map(str, bands.tolist()))


def _archive(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Stores every document as a member ``doc_id/bytes/number.png`` and then writes the index of finished archives."""
    store.make_dir(path)
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size, number, me = 0, 0, uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            uri, data = f"{path}/{me}-{number}.zip", _archive(held)
            store.write(uri, data)
            number, held, size = number + 1, [], 0
            tidy()
            return pa.RecordBatch.from_pydict({"archive": [uri], "bytes": [len(data)]})

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, payload = payload_of(text)
                data = to_png(payload)
                if held and size + len(data) > archive_bytes:
                    yield close()
                held.append((f"{'-' if doc_id is None else doc_id}/{n}/{len(held)}.png", data))
                size += len(data) + 256
        if held:
            yield close()

    made = written(docs.select("doc_id", "text").mapInArrow(run, "archive string, bytes long"), "media-archives")
    # one short line for each archive of ARCHIVE_BYTES
    store.write(f"{path}/{INDEX}", json.dumps(sorted([r["archive"], r["bytes"]] for r in made.collect())).encode())


def directory(uri: str, size: int) -> list[tuple[int, int, int, str]]:
    """(offset of the header, packed size, crc32, name) of the members, from the archive's central directory alone."""
    tail = store.read(uri, max(0, size - 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{uri} has no central directory")
    n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if n == 0xFFFF or start == 0xFFFFFFFF:
        where = struct.unpack("<Q", store.read(uri, size - len(tail) + at - 20, 20)[8:16])[0]
        n, length, start = struct.unpack("<QQQ", store.read(uri, where, 56)[32:56])
    raw, out, p = store.read(uri, start, length), [], 0
    for _ in range(n):
        crc, packed, _, a, b, c = struct.unpack("<IIIHHH", raw[p + 16 : p + 34])
        (offset,) = struct.unpack("<I", raw[p + 42 : p + 46])
        out.append((offset, packed, crc, raw[p + 46 : p + 46 + a].decode()))
        p += 46 + a + b + c
    return out


def member(uri: str, offset: int, packed: int, crc: int, attempts: int = ATTEMPTS, read=store.read) -> bytes:
    """One member's bytes, tried again by its offset; the checksum must agree."""
    for k in range(attempts):
        try:
            head = read(uri, offset, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member header")
            a, b = struct.unpack("<HH", head[26:30])
            data = read(uri, offset + 30 + a + b, packed)
            if zlib.crc32(data) != crc:
                raise ValueError("member fails its checksum")
            return data
        except (OSError, ValueError) as e:
            if k + 1 == attempts:
                raise OSError(f"{uri} at {offset}: {e} ({attempts} attempts)") from e
            time.sleep(0.05 * 2**k)
    raise AssertionError


class ByteRange(InputPartition):
    def __init__(self, uri: str, size: int, start: int, end: int):
        self.uri, self.size, self.start, self.end = uri, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        try:
            archives = json.loads(store.read(f"{self.path}/{INDEX}"))
        except FileNotFoundError:
            archives = [[u, n] for u, n in store.listing(self.path) if u.endswith(".zip")]
        out = [ByteRange(u, n, a, min(n, a + self.range_bytes)) for u, n in archives for a in range(0, n, self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["archive", "member", "offset", "media"])

        for offset, packed, crc, name in directory(part.uri, part.size):
            if part.start <= offset < part.end:
                rows.append((part.uri, name, offset, member(part.uri, offset, packed, crc)))
                size += packed
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("path", dir)``: archive, member, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"].rstrip("/"), int(self.options.get("rangebytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", path).load()


def described(media: DataFrame) -> DataFrame:
    """doc_id and the features of each member, all from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for name, data in zip(b.column("member").to_pylist(), b.column("media").to_pylist(), strict=True):
                doc_id, n, _ = name.split("/")
                p = from_png(data)
                for to, v in zip(rows, (None if doc_id == "-" else int(doc_id), int(n), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(p)), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    return media.select("member", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores the documents as archives in the shared folder, reads them back through the source and describes them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(docs, path)
    return described(read_archives(spark, path))
