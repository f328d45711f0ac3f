"""Exact substring deduplication by a sparse, range-partitioned suffix array.

A byte goes if a string of 400 bytes that covers it also starts anywhere else in the corpus. Shorter repeats, of 256 bytes (about 50
words) or more, stay and are counted. Every string of 256 bytes holds an anchor: of its 64-byte substrings the one with the least
hash, the leftmost of equals; a string of 400 bytes takes that of its first 256. Equal strings have equal anchors at equal offsets, so
only suffixes that start at anchors are sorted; about one byte in 100 starts one. The strings that share an anchor occurrence are a
run of starts; the run's context is the bytes that its strings of 400 bytes cover, to the text's end at most.

1. Texts that are equal form a node (with two or more of them, a text of 400 bytes goes whole); nodes are written once, in batches.
2. Anchors and contexts are counted over the corpus by their hashes, packed and summed by batch before they move. A context that
   occurs twice settles its whole run. An anchor with several contexts needs comparing: one occurrence of each context goes on.
3. Splitters sampled from anchors' leading bytes range-partition these suffixes into buckets of bounded size. A bucket sorts its
   suffixes, and the reversed texts before them, by multikey quicksort over eight-byte words; neighbours' common prefixes give,
   for either length n and every offset d, classes of equal n - d bytes after and d bytes before the anchor: a string occurs twice
   where both classes coincide. Splitters are shorter than an anchor, so an anchor's suffixes meet in a bucket; beyond ``RANGES``
   ranges, each is dealt to several buckets by its anchors, so that the splitters' sample stays bounded.
4. An anchor with more contexts than ``HOT`` is split over several buckets by context. There, what a bucket cannot settle is
   compared across boundaries: it sends one hash for each of its classes, and classes met in two buckets are settled too.
5. Batches get the decisions back, by exact offsets, and cut their texts.

Defined cases: null and empty texts lose nothing; repeated rows and equal texts count as occurrences of each other; null doc_ids are
kept; matches never cross documents; empty tables give empty results; further columns are ignored. Texts are used whole.
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
from .flat import U64, Rolling, byte_table, mix64, tidy
from .shared import bounded, partitions, written
from .texts import batched, spread, squeeze

LENGTH = 400
#: Bytes of the repeats that are counted as n_repeated.
LEAST = 256
ANCHOR = 64
LEAD = 16
#: Ranges of suffixes, at most; 32 samples of each reach the driver.
RANGES = 4096
BATCH_BYTES = 1_000_000
#: Bytes of the contexts in a bucket, about.
BUCKET_BYTES = 16_000_000
#: Contexts of one anchor in a bucket, at most about.
HOT = 20_000
PART_ANCHORS = 1_000_000
_BYTES = byte_table(3)


class Runs:
    """Anchor occurrences of a batch: anchor at, first and last start (lo, hi) of the strings of least bytes that have it, end of
    the context, hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, least: int, anchor: int):
        self.data, self.offs = data, offs
        n = len(data) - least + 1
        none = np.zeros(0, np.int64)
        self.at, self.lo, self.hi, self.end, self.h, self.ch = none, none, none, none, none.astype(U64), none.astype(U64)
        if n <= 0:
            return
        roll = Rolling(_BYTES[data])
        starts = np.arange(len(data) - anchor + 1)
        key = (roll.of(starts, starts + anchor) >> U64(32) << U64(32)) | starts.astype(U64)
        at = (_sliding_min(key, least - anchor + 1)[:n] & U64(0xFFFFFFFF)).astype(np.int64)
        room = np.repeat(offs[1:], np.diff(offs))[:n]
        good = np.arange(n) + least <= room
        first = good.copy()
        first[1:] &= ~good[:-1] | (at[1:] != at[:-1])
        last = good.copy()
        last[:-1] &= ~good[1:] | (at[1:] != at[:-1])
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.at = at[self.lo]
        self.end = np.minimum(self.hi + length, room[self.lo])
        # mixed once more: anchors have the least hashes of their strings, which would all go to the first parts
        self.h = mix64(roll.of(self.at, self.at + anchor) + U64(0x9E3779B97F4A7C15))
        self.ch = mix64(roll.of(self.lo, self.end) + (self.at - self.lo).astype(U64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], by running minima of blocks from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.append(x, np.full(pad, ~U64(0))).reshape(-1, width)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def _open(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    texts = unpack(z)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def _kinds(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of a batch in the order of a mixed key: (key, ch, count, first record)."""
    q = mix64(r.h ^ (r.ch << U64(1)) ^ (r.ch >> U64(63)))
    order = np.lexsort((r.ch, q))
    q, c = q[order], r.ch[order]
    new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))) if len(q) else np.zeros(0, np.int64)
    return q[new], c[new], np.diff(np.append(new, len(q))), order[new]


def _anchors(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a batch: (h, one of its contexts, number of its contexts)."""
    order = np.lexsort((r.ch, r.h))
    h, c = r.h[order], r.ch[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    h, c = h[new], c[new]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[head], c[head], np.diff(np.append(head, len(h)))


def _cut(sorted_keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of keys sorted by their leading bits."""
    part = (sorted_keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_keys), np.int64)
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return part[head], head, np.append(head[1:], len(part))


def roles(table: DataFrame, bits: int, length: int, least: int, anchor: int, hot: int) -> DataFrame:
    """(bid, part, blob, n_ctx, split): part < 2^bits: for the batch's contexts, 1 if it occurs again, 2 if this batch compares it;
    others: for its anchors, in how many buckets their contexts are compared (0: one context alone). n_ctx: the batch's contexts of
    anchors that are compared; split: is one of its anchors compared in several buckets."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bid, z in zip(b.column("bid").to_pylist(), b.column("z").to_pylist(), strict=True):
                r = Runs(*_open(z), length, least, anchor)
                part, keys, other, n = [], [], [], []
                for base, (k, c, m) in ((0, _kinds(r)[:3]), (1 << bits, _anchors(r))):
                    for p, x, y in zip(*_cut(k, bits), strict=True):
                        part.append(base + int(p))
                        keys.append(squeeze(np.diff(k[x:y], prepend=U64(0))))
                        other.append(squeeze(c[x:y]))
                        n.append(squeeze(np.minimum(m[x:y], 65535).astype(np.uint16)))
                yield pa.RecordBatch.from_arrays([pa.array([bid] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(keys, pa.binary()), pa.array(other, pa.binary()), pa.array(n, pa.binary())], names=["bid", "part", "keys", "other", "n"])
                tidy()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        bids, keys, other, n = [], [], [], []
        for b in batches:
            bids += b.column("bid").to_pylist()
            keys += [np.cumsum(spread(x, np.uint64), dtype=U64) for x in b.column("keys").to_pylist()]
            other += [spread(x, np.uint64) for x in b.column("other").to_pylist()]
            n += [spread(x, np.uint16) for x in b.column("n").to_pylist()]
        who = np.repeat(np.arange(len(bids)), [len(x) for x in keys])
        rank = np.argsort(np.argsort(np.array(bids)))[who]
        k, o, m = np.concatenate(keys), np.concatenate(other), np.concatenate(n).astype(np.int64)
        out = np.zeros(len(k), np.uint16)
        if part < 1 << bits:
            order = np.lexsort((rank, o, k))
            ks, os = k[order], o[order]
            head = np.flatnonzero(np.append(True, (ks[1:] != ks[:-1]) | (os[1:] != os[:-1])))
            total = np.add.reduceat(m[order], head)
            again = np.repeat(total > 1, np.diff(np.append(head, len(ks))))
            first = np.zeros(len(ks), bool)
            first[head] = True
            out[order] = again + 2 * first
        else:
            order = np.lexsort((o, k))
            ks, os = k[order], o[order]
            head = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
            size = np.diff(np.append(head, len(ks)))
            total = np.add.reduceat(m[order], head)
            several = (np.maximum.reduceat(m[order], head) > 1) | (os[head] != os[head + size - 1])
            out[order] = np.repeat(np.where(several, np.minimum(65535, 1 + (total - 1) // hot), 0), size)
        cuts = np.cumsum([0, *map(len, keys)])
        met = np.where(out > 0, m, 0) if part >= 1 << bits else np.zeros(len(k), np.int64)
        split = (out > 1) & (part >= 1 << bits)
        for i in range(0, len(bids), 256):
            j = min(len(bids), i + 256)
            own = [slice(cuts[x], cuts[x + 1]) for x in range(i, j)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bids[i:j], pa.int64()), pa.array([part] * (j - i), pa.int64()), pa.array([squeeze(out[x]) for x in own], pa.binary()), pa.array([int(met[x].sum()) for x in own], pa.int64()), pa.array([bool(split[x].any()) for x in own], pa.bool_())],
                names=["bid", "part", "blob", "n_ctx", "split"],
            )

    asked = table.select("bid", "z").mapInArrow(ask, "bid long, part long, keys binary, other binary, n binary")
    return asked.groupBy("part").applyInArrow(count, "bid long, part long, blob binary, n_ctx long, split boolean")


def _told(r: Runs, parts: list[int], blobs: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each record: does its context occur again; is it to be compared; over how many buckets."""
    mine = sorted((p, x) for p, x in zip(parts, blobs, strict=True) if p >= 0)
    one = np.concatenate([spread(x, np.uint16) for p, x in mine if p < 1 << bits] or [np.zeros(0, np.uint16)])
    two = np.concatenate([spread(x, np.uint16) for p, x in mine if p >= 1 << bits] or [np.zeros(0, np.uint16)])
    again, speak = np.zeros(len(r.at), bool), np.zeros(len(r.at), bool)
    if not len(r.at):
        return again, speak, np.zeros(0, np.int64)
    _, _, n, first = _kinds(r)
    q = mix64(r.h ^ (r.ch << U64(1)) ^ (r.ch >> U64(63)))
    again[np.lexsort((r.ch, q))] = np.repeat((one & 1) > 0, n)
    speak[first] = (one & 2) > 0
    heads = np.unique(r.h)
    over = two[np.searchsorted(heads, r.h)].astype(np.int64)
    return again, speak & (over > 0), over


def splitters(table: DataFrame, ranges: int, length: int, least: int, anchor: int) -> np.ndarray:
    """Leading bytes of sampled anchors that cut the suffixes into so many ranges; about 32 samples a range reach the driver."""
    if ranges <= 1:
        return np.zeros(0, f"S{LEAD}")
    n = table.count()
    each = max(8, 32 * ranges // min(n, 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in b.column("z").to_pylist():
                r = Runs(*_open(z), length, least, anchor)
                pick = np.argsort(mix64(r.h))[:each]
                yield pa.RecordBatch.from_pydict({"lead": [r.data[a : a + LEAD].tobytes() for a in r.at[pick].tolist()]}, schema=pa.schema([("lead", pa.binary())]))

    some = table if n <= 64 else table.filter(F.pmod(F.xxhash64("bid"), F.lit(n)) < 64)
    got = np.sort(np.array([bytes(r["lead"]) for r in some.select("z").mapInArrow(run, "lead binary").collect()], f"S{LEAD}"))
    return np.unique(got[np.linspace(0, len(got) - 1, ranges + 1).astype(np.int64)[1:-1]]) if len(got) else got


def multikey_order(words: np.ndarray, small: int = 256) -> np.ndarray:
    """Sorted order of rows of words, by multikey quicksort: a range of rows that agree in their first words is parted in three by a
    pivot for its next word; the rows equal to the pivot go on with the word after it. Small ranges are sorted at once."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, c = todo.pop()
        if b - a < 2 or c == words.shape[1]:
            continue
        own = order[a:b]
        if b - a <= small:
            order[a:b] = own[np.lexsort(words[own, c:].T[::-1])]
            continue
        key = words[own, c]
        pivot = np.sort(key[np.linspace(0, len(key) - 1, 9).astype(np.int64)])[4]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([own[less], own[same], own[more]])
        x, y = a + int(less.sum()), b - int(more.sum())
        todo += [(a, x, c), (x, y, c + 1), (y, b, c)]
    return order


def _rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row of width bytes for each range, forwards or backwards, with zeros behind."""
    out = np.zeros((len(start), width), np.uint8)
    cols = np.arange(width)
    for i in range(0, len(start), 4096):
        s, n = start[i : i + 4096, None], size[i : i + 4096, None]
        out[i : i + 4096] = np.where(cols < n, data[np.clip(s + step * cols, 0, max(0, len(data) - 1))], 0)
    return out


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in order with the one before."""
    out = np.zeros(len(order), np.int32)
    for i in range(1, len(order), 4096):
        a, b = rows[order[i : i + 4096]], rows[order[i - 1 : i - 1 + len(order[i : i + 4096])]]
        off = a != b
        out[i : i + 4096] = np.where(off.any(1), off.argmax(1), rows.shape[1])
    return out


def compare(data: np.ndarray, start: np.ndarray, size: np.ndarray, dmin: np.ndarray, dmax: np.ndarray, lengths: tuple[int, ...], anchor: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For suffixes with contexts at start, the anchor dmax bytes in, for each length: (twice, lead): twice[d, i]: the string that
    starts d bytes before anchor i occurs twice here; lead[d, i]: i is the first of its class."""
    m, most, reach = len(start), max(lengths), min(lengths) - anchor
    behind = size - dmax
    after = _rows(data, start + dmax, np.minimum(behind, most - dmin), -(-most // 8) * 8, 1)
    before = _rows(data, start + dmax - 1, dmax, max(8, -(-reach // 8) * 8), -1)
    ways = []
    for rows in (after, before):
        order = multikey_order(rows.view(">u8").astype(np.uint64))
        ways.append((order, _common(rows, order)))
    (oa, ca), (ob, cb) = ways
    right, left = np.zeros(m, np.int64), np.zeros(m, np.int64)
    out = []
    for length in lengths:
        twice, lead = np.zeros((reach + 1, m), bool), np.zeros((reach + 1, m), bool)
        for d in range(reach + 1):
            live = np.flatnonzero((dmin <= d) & (d <= dmax) & (behind >= length - d))
            if not len(live):
                continue
            right[oa] = np.cumsum(ca < length - d)
            left[ob] = np.cumsum(cb < d)
            both = right[live] * (m + 1) + left[live]
            o = np.argsort(both, kind="stable")
            s = both[o]
            same = s[1:] == s[:-1]
            dup = np.append(False, same)
            lead[d, live[o[~dup]]] = True
            dup[:-1] |= same
            twice[d, live[o[dup]]] = True
        out.append((twice, lead))
    return out


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first d, last d) of the runs of set flags[d, row]."""
    x = np.zeros((flags.shape[1], flags.shape[0] + 2), np.int8)
    x[:, 1:-1] = flags.T
    step = np.diff(x, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, a, b - 1


def contexts(table: DataFrame, told: DataFrame, cuts: np.ndarray, share: int, bits: int, length: int, least: int, anchor: int) -> DataFrame:
    """(bucket, bid, idx, hot, dmin, dmax, ctx) of the suffixes to compare; share: buckets of a range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in range(7)]
        for bid, z in zip(left.column("bid").to_pylist(), left.column("z").to_pylist(), strict=True):
            r = Runs(*_open(z), length, least, anchor)
            _, go, over = _told(r, right.column("part").to_pylist(), right.column("blob").to_pylist(), bits)
            idx = np.flatnonzero(go)
            raw = r.data.tobytes()
            at, lo, hi, end = (x[idx].tolist() for x in (r.at, r.lo, r.hi, r.end))
            bucket = np.searchsorted(cuts, np.array([raw[a : a + LEAD] for a in at], f"S{LEAD}"), side="right") if len(at) else np.zeros(0, np.int64)
            sub = (r.ch[idx] >> U64(20)) % np.maximum(over[idx], 1).astype(U64)
            salt = np.where(over[idx] > 1, (r.h[idx] >> U64(34)) * U64(65536) + sub + U64(1), (r.h[idx] >> U64(20)) % U64(share)).astype(np.int64)
            for to, v in zip(rows, ((bucket.astype(np.int64) << 47 | salt & ((1 << 47) - 1)).tolist(), [bid] * len(idx), idx.tolist(), (over[idx] > 1).tolist(), [a - b for a, b in zip(at, hi, strict=True)], [a - b for a, b in zip(at, lo, strict=True)], [raw[b:c] for b, c in zip(lo, end, strict=True)]), strict=True):
                to.extend(v)
        tidy()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["bucket", "bid", "idx", "hot", "dmin", "dmax", "ctx"])

    return table.select("bid", "z").groupBy("bid").cogroup(told.select("bid", "part", "blob").groupBy("bid")).applyInArrow(run, "bucket long, bid long, idx int, hot boolean, dmin int, dmax int, ctx binary")


def settled(ctx: DataFrame, lengths: tuple[int, int], anchor: int, any_hot: bool) -> DataFrame:
    """(bid, idx, size, d0, d1): strings of size bytes that start d0 to d1 bytes before the anchor occur twice."""
    names = ["bid", "idx", "size", "d0", "d1", "w"]

    def rows(bid: np.ndarray, idx: np.ndarray, length: int, d0: np.ndarray, d1: np.ndarray, w: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bid, pa.int64()), pa.array(idx, pa.int32()), pa.array(np.full(len(bid), length), pa.int32()), pa.array(d0, pa.int32()), pa.array(d1, pa.int32()), w], names=names)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        raw = t.column("ctx").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, t.num_rows)
        data = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        start = np.cumsum(size) - size
        dmin, dmax = (t.column(c).to_numpy().astype(np.int64) for c in ("dmin", "dmax"))
        bid, idx, hot = (np.asarray(t.column(c)) for c in ("bid", "idx", "hot"))
        for length, (twice, lead) in zip(lengths, compare(data, start, size, dmin, dmax, lengths, anchor), strict=True):
            row, a, b = _intervals(twice)
            yield rows(bid[row], idx[row], length, a, b, pa.nulls(len(row), pa.binary()))
            for i in np.flatnonzero(hot).tolist():  # across boundaries: one hash for each class of a split anchor
                ds = np.flatnonzero(lead[:, i])
                p = start[i] + dmax[i] - ds
                w = [hashlib.blake2b(data[x : x + length].tobytes(), digest_size=16).digest() for x in p.tolist()]
                yield rows(np.full(len(ds), bid[i]), np.full(len(ds), idx[i]), length, ds, ds, pa.array(w, pa.binary()))
        tidy()

    found = ctx.groupBy("bucket").applyInArrow(run, "bid long, idx int, size int, d0 int, d1 int, w binary")
    if not any_hot:
        return found.drop("w")
    found = written(found, "suffixes")
    met = found.filter(F.col("w").isNotNull())
    twice = met.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w")
    return found.filter(F.col("w").isNull()).drop("w").unionByName(met.join(twice, "w", "left_semi").drop("w"))


def cut(table: DataFrame, answers: DataFrame, bits: int, length: int, least: int, anchor: int) -> DataFrame:
    """(k, n_bytes, n_removed, n_spans, kept_sha256, spans, n_repeated) of each node from roles and settled strings."""
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_repeated"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        part = right.column("part").to_numpy(zero_copy_only=False)
        role = np.flatnonzero(part >= 0)
        parts, blobs = part[role].tolist(), right.column("blob").take(pa.array(role)).to_pylist()
        f = right.filter(pa.array(part < 0))
        idx, d0, d1, width = (f.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("idx", "d0", "d1", "size"))
        for ks, copies, z in zip(left.column("ks").to_pylist(), left.column("copies").to_pylist(), left.column("z").to_pylist(), strict=True):
            data, offs = _open(z)
            r = Runs(data, offs, length, least, anchor)
            again, _, _ = _told(r, parts, blobs, bits)
            copied = (np.array(copies) > 1)

            def covered(size: int) -> np.ndarray:
                """Bytes of the batch that repeated strings of so many bytes cover."""
                told = again & (r.end - r.lo >= size)
                whole, own = np.flatnonzero(copied & (np.diff(offs) >= size)), width == size
                edge = np.zeros(len(data) + 1, np.int64)
                for a, b in ((r.lo[told], np.minimum(r.hi[told] + size, r.end[told])), (r.at[idx[own]] - d1[own], r.at[idx[own]] - d0[own] + size), (offs[whole], offs[whole + 1])):
                    edge += np.bincount(a, minlength=len(edge)) - np.bincount(b, minlength=len(edge))
                return np.cumsum(edge[:-1]) > 0

            off, also = covered(length), covered(least)
            for i, k in enumerate(ks):
                a, b = offs[i], offs[i + 1]
                x = off[a:b]
                kept = data[a:b][~x] if x.any() else data[a:b]
                edge = np.diff(x.astype(np.int8), prepend=0, append=0)
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for to, v in zip(rows, (k, int(b - a), int(x.sum()), len(s), hashlib.sha256(kept.tobytes()).hexdigest(), ",".join(f"{p}:{q}" for p, q in zip(s.tolist(), e.tolist(), strict=True)), int((x | also[a:b]).sum())), strict=True):
                    to.append(v)
        tidy()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

    return table.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(run, "k string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, n_repeated long")


def dedup(docs: DataFrame, length: int = LENGTH, least: int = LEAST, anchor: int = ANCHOR, hot: int = HOT, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end, in bytes), n_repeated for every row."""
    spark = docs.sparkSession
    bounded(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.md5(text).alias("k"), text.alias("text"))
    table = written(batched(keyed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), batch_bytes), "texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    guess = max(1, 2 * int(size) // (least - anchor + 2))
    bits = max(math.ceil(math.log2(max(1, guess / PART_ANCHORS))), math.ceil(math.log2(max(1, partitions(spark)))))
    told = written(roles(table, bits, length, least, anchor, hot), "roles")
    n_ctx, split = told.agg(F.coalesce(F.sum("n_ctx"), F.lit(0)), F.coalesce(F.max("split"), F.lit(False))).first()
    buckets = max(1, math.ceil(n_ctx * 1.5 * length / bucket_bytes))
    cuts = splitters(table, min(ranges, buckets), length, least, anchor)
    found = settled(contexts(table, told, cuts, -(-buckets // ranges), bits, length, least, anchor), (length, least), anchor, split)
    none = [F.lit(None).cast("int").alias(c) for c in ("idx", "size", "d0", "d1")]
    answers = told.select("bid", "part", "blob", *none)
    answers = answers.unionByName(found.select("bid", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("blob"), "idx", "size", "d0", "d1"))
    done = cut(table, answers, bits, length, least, anchor)
    return keyed.select("doc_id", "k").join(done, "k").drop("k")
