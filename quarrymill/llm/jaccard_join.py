"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents link when the Jaccard similarity of their five-word shingle sets is 0.75 or more. The join returns classes: every
document's component under links.

1. Texts that are equal form a node; one text a node goes on, in batches written once.
2. Every shingle's frequency over all nodes is counted: batches send each slot (leading bits of the hash) once with its count,
   packed, to the slot's part, and get the frequencies back. Sharing a slot merely makes a shingle look more frequent.
3. A node orders its shingles by (frequency, hash), rarest first. With c = ceil(0.75 n), two sets that link share at least L
   shingles within their first n - c + L, for any L. A node chooses L by the estimated cost of its candidates (postings to read plus
   pairs to verify, which fall with L), and posts that longer prefix with the level at which each shingle enters. For two nodes the
   smaller L of both holds. Shingles of frequency 1 take up prefix but are never posted; a node with fewer than c others has no link.
4. First each node is compared with the most central node (hub) of its lists, and components are formed. Only pairs in
   different components are candidates after that. Two nodes with one hub are judged by how they differ from it: counts of
   hub shingles that a node lacks, and of further shared ones that it has, in ``BLOCKS`` blocks of hashes bound their overlap;
   most pairs that do not link fall here without being made. All other pairs are found by list and size, with sizes and
   shared counts that allow a link. A group of near copies thus costs a comparison a copy, not one a pair, and no link
   between components is lost.
5. Candidates are verified on their texts; the components of all links follow.

Defined cases: null, empty and blank texts have no shingle, n 0, and link with nothing: each row is its own class, also among equal ones; texts of fewer than five words have one
shingle; repeated rows and equal texts share a class; null doc_ids take part (a class of only null doc_ids has a null id);
empty tables give empty results; further columns are ignored. Texts are used whole; nothing is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import pack, unpack
from .flat import U64, flat, tidy
from .graph import components
from .shared import bounded, partitions, spare, written
from .shingles import shingles
from .texts import spread, squeeze

BATCH_BYTES = 1_000_000
PAIR_BYTES = 1_000_000
#: Shingles of a counting part, about.
PART_SHINGLES = 4_000_000
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
BLOCKS = 32
#: What verifying a pair costs, in postings read.
VERIFY = 50.0


def least_shared(a, b):
    """Least number of shared shingles with which sets of a and b link: 100 s >= 75 (a + b - s)."""
    return -(-3 * (a + b) // 7)


def _sets(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingles of a batch's texts, and the texts."""
    texts = unpack(blob)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    return *shingles(np.frombuffer(b"".join(texts), np.uint8), offs), texts


def batched(texts: DataFrame, batch_bytes: int) -> DataFrame:
    """(k, rep, text) to batches (bid, ks, reps, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, reps, held, size = [], [], [], 0
        tidy()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ks[0]]), pa.array([ks]), pa.array([reps], pa.list_(pa.int64())), pa.array([pack(held)], pa.binary())], names=["bid", "ks", "reps", "z"])

        for b in batches:
            for k, rep, text in zip(*(b.column(c).to_pylist() for c in ("k", "rep", "text")), strict=True):
                raw = text.encode()
                if held and (size + len(raw) > batch_bytes or len(held) >= 60_000):
                    yield close()
                    ks, reps, held, size = [], [], [], 0
                    tidy()
                ks.append(k)
                reps.append(rep)
                held.append(raw)
                size += len(raw)
        if held:
            yield close()

    return texts.mapInArrow(run, "bid string, ks array<string>, reps array<long>, z binary")


def frequencies(table: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """(bid, part, freq): for a batch's sorted distinct slots of the part, over how many nodes each is spread."""
    low_bits = bits - part_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bid, z in zip(b.column("bid").to_pylist(), b.column("z").to_pylist(), strict=True):
                _, h, _ = _sets(z)
                slot, n = np.unique(h >> U64(64 - bits), return_counts=True)
                part = (slot >> U64(low_bits)).astype(np.int64)
                low = slot & U64((1 << low_bits) - 1)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bid] * len(cuts), pa.string()), pa.array(part[cuts], pa.int64()), pa.array([squeeze(np.diff(low[a:e], prepend=U64(0))) for a, e in zip(cuts, ends, strict=True)], pa.binary()), pa.array([squeeze(np.minimum(n[a:e], 65535).astype(np.uint16)) for a, e in zip(cuts, ends, strict=True)], pa.binary())],
                    names=["bid", "part", "slots", "n"],
                )
                tidy()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bids, slots, ns = [], [], []
        for b in batches:
            bids += b.column("bid").to_pylist()
            slots += [np.cumsum(spread(x, np.uint64)) for x in b.column("slots").to_pylist()]
            ns += [spread(x, np.uint16) for x in b.column("n").to_pylist()]
        every = np.concatenate(slots)
        order = np.argsort(every)
        every, n = every[order], np.concatenate(ns).astype(np.int64)[order]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        total = np.add.reduceat(n, head)
        kinds, total = every[head][total > 1], total[total > 1]
        for i in range(0, len(bids), 64):
            out = []
            for s in slots[i : i + 64]:
                f = np.ones(len(s), np.uint32)
                if len(kinds):
                    at = np.minimum(np.searchsorted(kinds, s), len(kinds) - 1)
                    f = np.where(kinds[at] == s, np.minimum(total[at], 1 << 31), 1).astype(np.uint32)
                out.append(squeeze(f))
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array(bids[i : i + 64], pa.string()), pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bid", "part", "freq"])

    asked = table.select("bid", "z").mapInArrow(ask, "bid string, part long, slots binary, n binary")
    return asked.groupBy("part").applyInArrow(count, "bid string, part long, freq binary")


def choose_level(freq: np.ndarray, slack: int, c: int) -> int:
    """The L with the least estimated cost for frequencies in prefix order; slack = n - c."""
    best, cost = 1, math.inf
    for level in LEVELS:
        if level > c:
            break
        read = float(freq[: slack + level].sum())
        now = read + VERIFY * read / level
        if now < cost:
            best, cost = level, now
    return best


def prefixes(table: DataFrame, freqs: DataFrame, bits: int) -> DataFrame:
    """A row a node: k, rep, n, m (shingles that others have too), ell, toks and levs (posted prefix), often (a bit for each shingle: do others
    have it), z (text). Without a possible link the last five are null."""
    names = ["k", "rep", "n", "m", "ell", "toks", "levs", "often", "z"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        rows: list[list] = [[] for _ in names]
        parts = sorted(zip(right.column("part").to_pylist(), right.column("freq").to_pylist(), strict=True))
        freq = np.concatenate([spread(x, np.uint32) for _, x in parts] or [np.zeros(0, np.uint32)])
        for ks, reps, z in zip(left.column("ks").to_pylist(), left.column("reps").to_pylist(), left.column("z").to_pylist(), strict=True):
            doc, h, texts = _sets(z)
            slot = h >> U64(64 - bits)
            f = freq[np.searchsorted(np.unique(slot), slot)].astype(np.int64)
            cuts = np.searchsorted(doc, np.arange(len(ks) + 1))
            for i, k in enumerate(ks):
                fi = f[cuts[i] : cuts[i + 1]]
                n, m = len(fi), int((fi > 1).sum())
                c = -(-3 * n // 4)
                row: tuple = (k, reps[i], n, m, None, None, None, None, None)
                if n and m >= c:
                    order = np.argsort(fi, kind="stable")  # hashes are sorted already
                    fo = np.where(fi[order] > 1, fi[order], 0)
                    ell = choose_level(fo, n - c, c)
                    at = np.arange(n - m, n - c + ell)
                    if len(at):
                        toks = h[cuts[i] : cuts[i + 1]][order[at]].view(np.int64)
                        row = (k, reps[i], n, m, ell, toks, np.maximum(1, at + 1 - (n - c)).astype(np.int32), np.packbits(fi > 1).tobytes(), shrink(texts[i]))
                for to, v in zip(rows, row, strict=True):
                    to.append(v)
        tidy()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

    spec = "k string, rep long, n int, m int, ell int, toks array<long>, levs array<int>, often binary, z binary"
    return table.groupBy("bid").cogroup(freqs.groupBy("bid")).applyInArrow(run, spec)


def _both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, za, zb, oa) with the texts of pairs."""
    text = nodes.filter(F.col("z").isNotNull())
    return pairs.join(text.select(F.col("k").alias("a"), F.col("z").alias("za"), F.col("often").alias("oa")), "a").join(text.select(F.col("k").alias("b"), F.col("z").alias("zb")), "b")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch, about PAIR_BYTES of texts at a time."""
    import zstandard

    size = zstandard.frame_content_size
    first, total = 0, 0
    for i, (x, y) in enumerate(zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True)):
        total += size(x) + size(y)
        if total >= PAIR_BYTES:
            yield batch.slice(first, i + 1 - first)
            tidy()
            first, total = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _judge(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shingles of a, shingles of b, which of a's are in b) of a batch of pairs."""
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    a_k, b_k = b.column("a").to_pylist(), b.column("b").to_pylist()
    held: dict[str, int] = {}
    texts = []
    for k, z in zip([*a_k, *b_k], [*b.column("za").to_pylist(), *b.column("zb").to_pylist()], strict=True):
        if k not in held:
            held[k] = len(texts)
            texts.append(plain(z))
    doc, h = shingles(*flat(pa.array(texts, pa.binary())))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, (x, y) in enumerate(zip(a_k, b_k, strict=True)):
        s, t = h[cuts[held[x]] : cuts[held[x] + 1]], h[cuts[held[y]] : cuts[held[y] + 1]]
        yield i, s, t, t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s


def _links(s: np.ndarray, t: np.ndarray, both: np.ndarray) -> bool:
    shared = int(both.sum())
    return 100 * shared >= 75 * (len(s) + len(t) - shared)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                keep = pa.array([_links(s, t, both) for _, s, t, both in _judge(b)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return _both(pairs, nodes).mapInArrow(run, "a string, b string")


def stars(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, link, n, n_hub, lacks, extra): a node and its hub b; how many of the hub's shingles it lacks, and how many others that it
    shares with anyone it has, by block of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = U64(64 - BLOCKS.bit_length() + 1)
        for batch in batches:
            for b in _slices(batch):
                link, n, n_hub, lacks, extra = [], [], [], [], []
                for (_, s, t, both), often in zip(_judge(b), b.column("oa").to_pylist(), strict=True):
                    mask = np.unpackbits(np.frombuffer(often, np.uint8), count=len(s)) > 0
                    link.append(_links(s, t, both))
                    n.append(len(s))
                    n_hub.append(len(t))
                    lacks.append(np.bincount((t >> shift).astype(np.int64), minlength=BLOCKS) - np.bincount((s[both] >> shift).astype(np.int64), minlength=BLOCKS))
                    extra.append(np.bincount((s[mask & ~both] >> shift).astype(np.int64), minlength=BLOCKS))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(link, pa.bool_()), pa.array(n, pa.int32()), pa.array(n_hub, pa.int32()), pa.array(lacks, ints), pa.array(extra, ints)], names=["a", "b", "link", "n", "n_hub", "lacks", "extra"])

    return _both(pairs, nodes).mapInArrow(run, "a string, b string, link boolean, n int, n_hub int, lacks array<int>, extra array<int>")


def hub_pairs(star: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs with one hub, in different components, whose differences from the hub allow a link."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    t = star.join(labels.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("comp", F.coalesce("label", "a"))
    t = t.select(F.col("b").alias("hub"), F.col("a").alias("k"), "n", "n_hub", "lacks", "extra", "link", "comp").withColumn("most", F.col("n_hub") - total("lacks") + total("extra"))
    least = t.groupBy("hub").agg(F.min("n").alias("n_min"))
    x = t.filter(~F.col("link")).join(least, "hub").filter(7 * F.col("most") >= 3 * (F.col("n") + F.col("n_min"))).drop("n_min")
    side = lambda d, p: d.select("hub", *[F.col(c).alias(f"{p}_{c}") for c in ("k", "n", "n_hub", "lacks", "extra", "link", "comp", "most")])
    needs = 3 * (F.col("x_n") + F.col("y_n"))
    may = (F.col("x_comp") != F.col("y_comp")) & (F.col("y_link") | (F.col("x_k") < F.col("y_k"))) & (7 * F.least("x_most", "y_most") >= needs)
    bound = F.col("x_n_hub") - total(F.zip_with("x_lacks", "y_lacks", lambda p, q: F.greatest(p, q))) + total(F.zip_with("x_extra", "y_extra", lambda p, q: F.least(p, q)))
    return side(x, "x").join(side(t, "y"), "hub").filter(may & (7 * bound >= needs)).select(F.col("x_k").alias("a"), F.col("y_k").alias("b"))


def star_pairs(post: DataFrame) -> DataFrame:
    """(a, b): for each node the hub that shares most of its posted shingles, where sizes allow a link."""
    hub = post.groupBy("tok").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("r"), "n", "m", "k")).alias("hub"), F.count(F.lit(1)).alias("c_")).filter("c_ > 1")
    near = post.join(hub, "tok").filter(F.col("k") != F.col("hub.k"))
    needs = F.ceil(F.lit(3) * (F.col("n") + F.col("hub.n")) / F.lit(7))
    near = near.filter((F.least("m", "hub.m") >= needs) & (F.least("n", "hub.n") >= needs))
    shared = near.groupBy("k", F.col("hub.k").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return shared.groupBy("k").agg(F.max(F.struct("c", "b")).alias("best")).select(F.col("k").alias("a"), F.col("best.b").alias("b"))


def _size_step(n):
    return F.floor(F.log(n.cast("double")) * 12).cast("int")


def cross_pairs(post: DataFrame, labels: DataFrame, star: DataFrame) -> DataFrame:
    """(a, b): candidates of different hubs and components with enough shared prefix shingles, each pair once."""
    p = post.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("label", "k")).drop("label")
    p = p.join(star.select(F.col("a").alias("k"), F.col("b").alias("hub")), "k", "left").withColumn("hub", F.coalesce("hub", "k"))
    mixed = p.groupBy("tok").agg(F.min("comp").alias("lo_"), F.max("comp").alias("hi_")).filter("lo_ <> hi_").select("tok")
    p = p.join(mixed, "tok", "left_semi")
    low, high = F.ceil(F.col("n") * 3 / 4), F.least(F.col("n"), F.floor(F.col("m") * 7 / 3).cast("int") - F.col("n"))
    x = p.withColumn("low", low).withColumn("high", high).filter("high >= low").withColumn("size", F.explode(F.sequence(_size_step(F.col("low")), _size_step(F.col("high")))))
    x = x.select("tok", "size", *[F.col(c).alias(f"x_{c}") for c in ("k", "n", "m", "ell", "lev", "comp", "hub", "low", "high")])
    y = p.select("tok", _size_step(F.col("n")).alias("size"), *[F.col(c).alias(f"y_{c}") for c in ("k", "n", "m", "ell", "lev", "comp", "hub")])
    ell = F.least("x_ell", "y_ell")
    needs = F.ceil(F.lit(3) * (F.col("x_n") + F.col("y_n")) / F.lit(7))
    apart = (F.col("x_hub") != F.col("y_hub")) & (F.col("x_hub") != F.col("y_k")) & (F.col("x_k") != F.col("y_hub"))
    may = apart & (F.col("x_comp") != F.col("y_comp")) & F.col("y_n").between(F.col("x_low"), F.col("x_high")) & ((F.col("y_n") < F.col("x_n")) | (F.col("y_k") < F.col("x_k")))
    may &= (F.greatest("x_lev", "y_lev") <= ell) & (F.least("x_m", "y_m") >= needs)
    met = x.join(y, (x["tok"] == y["tok"]) & (x["size"] == y["size"]) & may)
    return met.groupBy(F.col("x_k").alias("a"), F.col("y_k").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(ell).alias("ell")).filter("c >= ell").select("a", "b")


def join(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    bounded(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.md5(text).alias("k"), text.alias("text"))
    table = written(batched(keyed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text")), batch_bytes), "texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    guess = max(1, int(size) // 6)
    part_bits = max(math.ceil(math.log2(max(1, guess / PART_SHINGLES))), math.ceil(math.log2(max(1, partitions(spark)))))
    bits = min(60, max(part_bits + 8, math.ceil(math.log2(guess)) + 5))
    nodes = written(prefixes(table, frequencies(table, bits, part_bits), bits), "prefixes")
    return classes(keyed.select("doc_id", "k"), nodes)


def classes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id from members (doc_id, k) and nodes with their prefixes."""
    post = nodes.filter(F.col("toks").isNotNull()).select("k", "n", "m", "ell", F.explode(F.arrays_zip("toks", "levs")).alias("t")).select("k", "n", "m", "ell", F.col("t.toks").alias("tok"), F.col("t.levs").alias("lev"))
    star = written(stars(star_pairs(post), nodes), "stars")
    links = star.filter("link").select("a", "b")
    labels = components(links)
    others = hub_pairs(star, labels).unionByName(cross_pairs(post, labels, star))
    cross = written(verified(others, nodes), "links")
    if not cross.isEmpty():
        labels = components(links.unionByName(cross))
    comp = nodes.select("k", "rep", "n").join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    ids = comp.groupBy("label").agg(F.min("rep").alias("component_id"))
    comp = comp.join(ids, "label").select("k", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(comp, "k").select("doc_id", "n_shingles", alone.alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id stays. Classes without a doc_id and rows
    without a word stay whole."""
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    every, docs = docs, docs.filter(word)
    keep = join(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    digest = spare(docs.columns, "digest")[0]
    named = docs.join(keep, "doc_id", "left_semi").withColumn(digest, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    named = named.dropDuplicates(["doc_id", digest]).drop(digest)
    return named.unionByName(every.filter(F.col("doc_id").isNull() | ~word)).select(*[F.col(f"`{c}`") for c in every.columns])
