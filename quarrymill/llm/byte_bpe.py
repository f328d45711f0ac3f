"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are dealt into batches once. In a batch, each match of the pattern (a word) that is not itself a token goes out once,
packed with others by the digest of the word; there each distinct word of the corpus is encoded once by merge ranks; the ids
go back to the batches that asked and are joined with the words by their positions in the texts. Words that are tokens need
no shuffle: their id is in the rank table, which is sent to the workers (its size is the vocabulary's). Decoding looks ids up
in the token-byte table.

Where the order of the documents counts (a mixed stream), batches are shards of consecutive documents instead of texts dealt by hash, and each document
gets its place, its shard and where its tokens begin in it.

Both uses of a batch read one exchange of the texts. A word that a third of all texts holds goes out once a batch.

Defined cases: null text is the empty text: no ids, the digest of the empty string; repeated rows each get a row; null
doc_ids stay null; an empty table gives an empty result; further columns are ignored. Texts and words of any length are used whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flat import tidy
from .shared import bounded, parts_for, with_place

#: Bytes of text in a batch, about.
BATCH_BYTES = 8_000_000
#: Runs of rows, at most, by which a stream of documents is cut to shards (a row each is broadcast), and rows in a run, at least.
RUNS, RUN_ROWS = 65_536, 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a .tiktoken file (base64 token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """findall of a pattern. Properties and white space become explicit character classes for the standard library's matcher, which
    is faster; the classes are read off the regex module. A pattern with other escapes keeps that module.

    The matcher looks up classes of the first 65,536 code points in a table but scans further ranges one by one, so texts without
    further code points (told by the width of their representation) use classes without them.
    """
    import re
    import sys

    import regex

    rest = re.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern)
    if "\\" in rest:
        return regex.compile(pattern).findall

    def compiled(most: int):
        every = "".join(chr(c) for c in range(most) if not 0xD800 <= c < 0xE000)

        def ranges(name: str) -> str:
            return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(ord(c) for c in regex.findall(name, every)))

        out, inside = [], False
        for tok in re.findall(r"\\p\{[LN]\}|\\[sS]|[\s\S]", pattern):
            if tok in ("[", "]"):
                inside = tok == "["
                out.append(tok)
            elif tok == "\\S":
                out.append(f"[^{ranges(chr(92) + 's')}]")
            elif tok[0] == "\\":
                out.append(ranges(tok) if inside else f"[{ranges(tok)}]")
            else:
                out.append(tok)
        return re.compile("".join(out)).findall

    narrow, wide = compiled(0x10000), compiled(0x110000)

    def words(text: str) -> list[str]:
        n = len(text)
        far = sys.getsizeof(text) > 3 * n + 100 if n > 200 else max(text, default="") > "\uffff"
        return (wide if far else narrow)(text)

    return words


def _runs(points) -> list[tuple[int, int]]:
    """Maximal runs of ascending integers."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


class Codec:
    """Splits texts into words and encodes single words; made once in a worker's task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.words = splitter(pattern)
        self.ranks = ranks
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.table[v] = k
        self.whole = {}
        for k, v in ranks.items():
            try:
                self.whole[k.decode()] = v
            except UnicodeDecodeError:
                pass
        # the pattern takes any word as one piece: words are split already
        self.bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def one(self, word: bytes) -> list[int]:
        return self.bpe.encode_ordinary(word.decode())

    def rare(self, texts: list[str]) -> set[str]:
        """Distinct words that are no tokens."""
        out: set[str] = set()
        for t in texts:
            out.update(self.words(t))
        return out.difference(self.whole)


def pack(parts: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts))


def unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    ends = np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], np.uint32), dtype=np.int64) + 4 + 4 * n
    out, last = [], 4 + 4 * n
    for e in ends.tolist():
        out.append(raw[last:e])
        last = e
    return out


def dealt(words: set[str], parts: int) -> dict[int, list[bytes]]:
    """The words by the part that encodes them, each part's sorted."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        raw = w.encode()
        out.setdefault(zlib.crc32(raw) % parts, []).append(raw)
    for x in out.values():
        x.sort()
    return out


def _codec(sent) -> Codec:
    """The worker's codec, kept with the broadcast value from task to task."""
    held = sent.value
    if "codec" not in held:
        held["codec"] = Codec(held["ranks"], held["pattern"])
    return held["codec"]


def _texts(blobs: list[bytes]) -> list[str]:
    return [x.decode() for z in blobs for x in unpack(z)]


def in_shards(docs: DataFrame, n_rows: int, batch_bytes: int) -> DataFrame:
    """doc_id, text, place (the row's number in the order as written), batch: shards of consecutive rows, of about batch_bytes of text each. Bytes are
    summed by runs of rows, so a shard goes beyond its measure by a run at most."""
    t = with_place(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "place")
    t = t.withColumn("run_", F.floor(F.col("place") / max(RUN_ROWS, -(-n_rows // RUNS))))
    runs = t.groupBy("run_").agg(F.sum(F.octet_length("text")).alias("b_"))
    before = F.sum("b_").over(Window.orderBy("run_")) - F.col("b_")  # a row a run
    return t.join(F.broadcast(runs.select("run_", F.floor(before / batch_bytes).alias("batch"))), "run_").select("doc_id", "text", "place", "batch")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, batch_bytes: int = BATCH_BYTES, stream: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with_ids: and ids. stream: the rows in the order as written make one stream of tokens, in
    shards of about batch_bytes of text; then batches are shards, and come with place (the row's number in the stream), shard and start (tokens
    before it in its shard)."""
    spark = docs.sparkSession
    bounded(spark, 4000)
    size, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-int(size) // batch_bytes))
    parts = parts_for(spark, n, 4)
    sent = spark.sparkContext.broadcast({"ranks": ranks, "pattern": pattern})
    text = F.coalesce(F.col("text"), F.lit(""))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[int, tuple[list, list, list[bytes]]] = {}
            for doc_id, t, place, k in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "place", "batch")), strict=True):
                ids, places, held = groups.setdefault(k, ([], [], []))
                ids.append(doc_id)
                places.append(place)
                held.append(t.encode())
            ids, places, held = zip(*groups.values(), strict=True) if groups else ((), (), ())
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (ids, places)]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), *longs, pa.array([pack(x) for x in held], pa.binary())], names=["batch", "doc_ids", "places", "z"])

    dealt_out = in_shards(docs, n_rows, batch_bytes) if stream else docs.select("doc_id", text.alias("text"), F.lit(0).cast("long").alias("place"), F.pmod(F.xxhash64("doc_id", text), F.lit(n)).alias("batch"))
    base = dealt_out.mapInArrow(squeeze, "batch long, doc_ids array<long>, places array<long>, z binary")

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        found: set[str] = set()
        for b in batches:
            found |= codec.rare(_texts(b.column("z").to_pylist()))
        own = dealt(found, parts)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(own), pa.int64()), pa.array(list(own), pa.int32()), pa.array([pack(x) for x in own.values()], pa.binary())], names=["batch", "part", "blob"])

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(sent), {}
        kind = np.uint16 if len(codec.table) <= 65536 else np.uint32
        for b in batches:
            out = []
            for blob in b.column("blob").to_pylist():
                ids = []
                for w in unpack(blob):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(codec.one(w), kind).tobytes()
                    ids.append(got)
                out.append(pack(ids))
            yield pa.RecordBatch.from_arrays([b.column("batch"), b.column("part"), pa.array(out, pa.binary())], names=["batch", "part", "ids"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        codec = _codec(sent)
        kind = np.uint16 if len(codec.table) <= 65536 else np.uint32
        # words by their numbers in this batch, in text order
        number: defaultdict[str, int] = defaultdict(count().__next__)
        texts = [array("i", map(number.__getitem__, codec.words(t))) for t in _texts(left.column("z").to_pylist())]
        doc_ids, places = ([x for c in left.column(k).to_pylist() for x in c] for k in ("doc_ids", "places"))
        if stream:
            turn = sorted(range(len(places)), key=places.__getitem__)
            texts, doc_ids, places = ([x[i] for i in turn] for x in (texts, doc_ids, places))
        own = dealt(number.keys() - codec.whole.keys(), parts)
        ids_of: dict[bytes, list[int]] = {}
        for part, blob in zip(right.column("part").to_pylist(), right.column("ids").to_pylist(), strict=True):
            flat = unpack(blob)
            ids_of.update(zip(own[part], (np.frombuffer(x, kind).tolist() for x in flat), strict=True))
        ids = [[codec.whole[w]] if w in codec.whole else ids_of[w.encode()] for w in number]
        said = [" ".join(map(str, x)) for x in ids]
        back = [b"".join([codec.table[i] for i in x]) for x in ids]
        n_tokens, digest, plain, each = [], [], [], []
        for t in texts:
            s = " ".join(map(said.__getitem__, t)).encode()
            n_tokens.append(s.count(b" ") + 1 if s else 0)
            digest.append(hashlib.sha256(s).hexdigest())
            plain.append(hashlib.sha256(b"".join(map(back.__getitem__, t))).hexdigest())
            if with_ids:
                each.append([i for w in t for i in ids[w]])
        tidy()
        cols = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(plain, pa.string())}
        if with_ids:
            cols["ids"] = pa.array(each, pa.list_(pa.int32()))
        if stream:
            starts = [0, *accumulate(n_tokens)][: len(n_tokens)]
            shard = left.column("batch").to_pylist()[0] if places else 0
            cols |= {"place": pa.array(places, pa.int64()), "shard": pa.array([shard] * len(places), pa.int64()), "start": pa.array(starts, pa.int64())}
        return pa.table(cols)

    asked = base.groupBy("batch").applyInArrow(ask, "batch long, part int, blob binary")
    answered = asked.groupBy("part").applyInArrow(answer, "batch long, part int, ids binary")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", place long, shard long, start long" * stream
    return base.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(join, out)


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, bytes): ids with their positions are joined with the token-byte table, then put together again.

    Rows are told apart by doc_id and ids; the table's size is the vocabulary's, so it is broadcast. A row with an id (or null) that has
    no token has null bytes.
    """
    spark = coded.sparkSession
    table = spark.createDataFrame([(v, bytearray(k)) for k, v in ranks.items()], "id int, token binary")
    rows = coded.select("doc_id", "ids").distinct().withColumn("row_", F.xxhash64("doc_id", "ids"))
    each = rows.select("doc_id", "row_", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id", "left")
    whole = each.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("token").alias("h")))).alias("t"))
    known = ~F.exists("t", lambda x: x["h"].isNull())
    whole = whole.select("row_", F.when(known, F.unhex(F.array_join(F.transform("t", lambda x: x["h"]), ""))).alias("bytes"))
    keyed = coded.select("doc_id", "ids", F.xxhash64("doc_id", "ids").alias("row_"))
    return keyed.join(whole, "row_", "left").select("doc_id", F.when(F.coalesce(F.size("ids"), F.lit(0)) > 0, F.col("bytes")).otherwise(F.lit(b"")).alias("bytes"))
