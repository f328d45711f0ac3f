"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +-1. A letter trigram binds its letters' vectors, the first permuted twice and
the second once, by multiplication; a text bundles its trigrams by addition; a language's prototype bundles the unit
vectors of its training texts. A text is compared with the prototypes by cosine.

Training takes at most ``SAMPLE`` documents of each language, picked by a digest of the id, from rows with a language
whose crc32(doc_id as text) mod 4 is not 2; it is a documented bound of the fit, prediction covers every row.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0; nulls in lang are not trained
on; repeated rows each get a row; ties go to the first language by name; without any training row everything is ``und``;
further columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import mix64, tidy
from .shared import bounded, spare

DIM = 1024
SYMBOLS = 64
#: At most about so many training documents of a language.
SAMPLE = 3000
_SLICE = 250_000  # characters worked on at once
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def letters() -> np.ndarray:
    """SYMBOLS x DIM of +-1 from a fixed mixer; symbol 0 is the gap between words."""
    bits = mix64(np.arange(1, SYMBOLS * DIM // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(np.unpackbits(bits.view(np.uint8)).reshape(SYMBOLS, DIM) == 1, 1, -1).astype(np.int8)


def symbols(points: np.ndarray) -> np.ndarray:
    """Code points to symbols: letters a-z have their own, other letters share the rest by a multiplier, all else is 0."""
    kinds, back = np.unique(points, return_inverse=True)
    alpha = np.fromiter((chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in kinds.tolist()), bool, len(kinds))
    own = np.where((kinds >= 97) & (kinds <= 122), kinds - 96, 27 + (kinds.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27))
    return np.where(alpha, own, 0).astype(np.uint8)[back]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram, count), sorted by document. Words keep one gap on each side."""
    joined = " \0 ".join(t.replace("\0", " ").lower().replace("\0", " ") for t in texts)
    points = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.cumsum(points == 0, dtype=np.uint32)
    s = symbols(points)
    keep = (s > 0) | np.append(True, (s[:-1] > 0) | (points[:-1] == 0))  # of gaps the first, and each document's own
    s, doc = s[keep].astype(np.uint32), doc[keep]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = s[:-2] * np.uint32(SYMBOLS * SYMBOLS) + s[1:-1] * np.uint32(SYMBOLS) + s[2:]
    good = (doc[:-2] == doc[2:]) & ~((s[:-2] == 0) & (s[1:-1] == 0)) & ((s[:-2] > 0) | (s[1:-1] > 0)) & ((s[1:-1] > 0))
    key = (doc[:-2][good] << np.uint32(18)) | code[good]
    key, n = np.unique(key, return_counts=True)
    return (key >> np.uint32(18)).astype(np.int64), (key & np.uint32(0x3FFFF)).astype(np.int64), n


def unit_vectors(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, unit vector) of each text that has a letter trigram."""
    table = letters()
    first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < 16000 and (j == i or size + len(texts[j]) <= _SLICE):
            size += len(texts[j])
            j += 1
        doc, code, n = trigrams(texts[i:j])
        kinds, back = np.unique(code, return_inverse=True)
        bound = first[kinds >> 12] * second[(kinds >> 6) & 63] * table[kinds & 63]
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            a, b = cuts[d], cuts[d + 1]
            if b > a:
                v = n[a:b].astype(np.float32) @ bound[back[a:b]].astype(np.float32)
                yield i + d, v / max(float(np.sqrt(v @ v)), 1e-12)
        i = j


def _lists(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes). What reaches the driver is one vector for each language and one of at most 16 tasks."""
    bounded(docs.sparkSession)
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 != 2))
    counts = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n_"))
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n_")
    picked = pool.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").filter(pick).select("lang", "text").repartition(16)  # the scan keeps its tasks; the bounded sample moves

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for i, v in unit_vectors(_lists(b, "text")):
                whole = np.rint(v * (1 << 20)).astype(np.int64)  # sums of integers are the same in any order
                sums[langs[i]] = sums[langs[i]] + whole if langs[i] in sums else whole
            tidy()
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for r in picked.mapInArrow(bundle, "lang string, v array<long>").collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"], np.int64)
    names = sorted(total)
    if not names:
        return [], np.zeros((0, DIM), np.float32)
    m = np.stack([total[k] for k in names]).astype(np.float64)
    return names, (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; keep: adds lang_pred and score, or like names that are free, to the columns of docs instead."""
    names, protos = model
    bounded(docs.sparkSession)

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        said, score = ["und"] * len(texts), np.zeros(len(texts))
        if names:
            for i, v in unit_vectors(texts):
                like = protos @ v
                k = int(np.argmax(like))
                said[i], score[i] = names[k], min(1.0, max(0.0, float(like[k])))
        return said, score

    if keep:
        extra = spare(docs.columns, "lang_pred", "score")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                said, score = judge(_lists(b, "text"))
                tidy()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said), pa.array(score)], names=[*b.schema.names, *extra])

        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(add, f"{spec}, {extra[0]} string, {extra[1]} double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, score = judge(_lists(b, "text"))
            tidy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(said), pa.array(score)], schema=_OUT)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame) -> DataFrame:
    """The documents in a learned language. Those without a letter (``und``) go; short texts stay, however low their cosine."""
    judged = predict(docs, fit(docs), keep=True)
    return judged.filter(F.col(spare(docs.columns, "lang_pred")[0]) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])
