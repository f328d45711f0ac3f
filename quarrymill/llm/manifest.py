"""Merkle manifest of a dataset: one root over all sources, a proof of inclusion for every row, verification after tampering.

A row's leaf is ``H`` (lowercase hex SHA-256) of its fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Within
a source leaves ascend by doc_id; every ``ARITY`` consecutive nodes of a level become the ``H`` of their digests (the last run may be
shorter, even one node) until one remains, the source's subroot. Subroots in the order of sources give the root in the same way.

The tree is an associative sparse-forest monoid. A fragment is a set of unresolved nodes keyed by (tree, level, index); the union of two
fragments is followed by :func:`close`, which replaces a run of siblings by its parent as soon as all of them are there. As every tree's
number of leaves is known, so is the arity of every run, the last one's too. Rows are range-partitioned by (source, doc_id), so a
partition's fragment keeps nodes at its two edges alone, some ten a level. :func:`tree_reduce` merges ``FAN`` fragments at a time until one
is left; it is a treeReduce whose inner states stay as tables, for the way back hands every fragment the paths from its nodes to the root.

Defined cases: rows without doc_id come first in their source and are not tampered with; rows of one doc_id are ordered by leaf, equal rows
are interchangeable and each has a place and a proof of its own; the null source comes first and is not the empty one; a single row is
its own subroot, a single source's subroot the root, and without siblings the proof digests the empty string; an empty table gives an
empty result and no root (:func:`root` gives None); further columns are ignored. Texts are used whole and leave the rows with the first step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, parts_for, written, written_small

ARITY = 3
#: Rows of a leaf partition, about.
PART_ROWS = 50_000
#: Fragments merged at once.
FAN = 16
#: The tree of subroots; trees of sources are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Key = tuple[int, int, int]
NODE = "frag long, tree long, level int, idx long, n long, digest string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def piece(c: Column) -> Column:
    """A field as it enters a leaf."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[piece(c) for c in fields]), 256)


def stripped(docs: DataFrame) -> dict[str, Column]:
    """The contract's tampering: texts lose their line feeds where 2 divides the CRC-32 of the doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return {"text": F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@lru_cache(maxsize=None)
def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return n if not level else -(-width(n, level - 1) // ARITY)


def close(nodes: dict[Key, str], sizes: dict[int, int], above: dict[Key, tuple] | None = None) -> dict[Key, str]:
    """Resolves every complete run; above gets (left siblings, right siblings, parent) of each node that goes, or
    (None, subroot, place in the top tree) of a subroot."""
    todo = list(nodes)
    while todo:
        key = todo.pop()
        if key not in nodes:
            continue
        tree, level, i = key
        w = width(sizes[tree], level)
        if w == 1:
            if tree == TOP:
                continue
            parent, run, digest = (TOP, 0, tree), [key], nodes[key]
            if above is not None:
                above[key] = (None, digest, parent)
        else:
            first = i - i % ARITY
            run = [(tree, level, j) for j in range(first, min(first + ARITY, w))]
            parts = [nodes.get(k) for k in run]
            if None in parts:
                continue
            parent, digest = (tree, level + 1, first // ARITY), h("".join(parts))
            if above is not None:
                for j, k in enumerate(run):
                    above[k] = ("".join(parts[:j]), "".join(parts[j + 1 :]), parent)
        for k in run:
            del nodes[k]
        nodes[parent] = digest
        todo.append(parent)
    return nodes


def merge(a: dict[Key, str], b: dict[Key, str], sizes: dict[int, int], above: dict[Key, tuple] | None = None) -> dict[Key, str]:
    """The monoid's operation; its unit is the empty fragment."""
    return close(a | b, sizes, above)


def steps(key: Key, above: dict[Key, tuple], ends: dict[Key, list]) -> list[tuple]:
    """(left, right) from a node to the root; a subroot's place as (None, subroot)."""
    out = []
    while key in above:
        left, right, key = above[key]
        out.append((left, right))
    return out + ends[key]


def said(path: list[tuple]) -> str:
    return "/".join(f"={right}" if left is None else f"{left}.{right}" for left, right in path)


def heard(path: str) -> list[tuple]:
    return [(None, x[1:]) if x[0] == "=" else tuple(x.split(".")) for x in path.split("/")] if path else []


def fold(digest: str, path: list[tuple]) -> str:
    for left, right in path:
        if left is not None:
            digest = h(left + digest + right)
    return digest


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(source, doc_id, leaf, other): other is the leaf of the tampered row where it differs. The only step that sees texts."""
    given, changed = [F.col(c) for c in fields], [(tampered or {}).get(c, F.col(c)) for c in fields]
    apart = F.lit(False)
    for a, b in zip(given, changed, strict=True):
        apart = apart | ~a.eqNullSafe(b)
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(given)).alias("leaf"), F.when(apart, F.unhex(leaf(changed))).alias("other"))


def placed(table: DataFrame, part_rows: int) -> tuple[DataFrame, int]:
    """Rows of a written leaf table in their order over so many parts: at is the part's number (shifted) and the place in it."""
    parts = parts_for(table.sparkSession, table.count(), part_rows)
    order = ["source", "doc_id", "leaf", "tie"]  # ties are equal rows; the number deals many of them over parts
    rows = table.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(rows.drop("tie").withColumn("at", F.monotonically_increasing_id()), "manifest"), parts


def bearings(rows: DataFrame) -> tuple[dict[int, tuple], int]:
    """({part: (rank of its first source, rows of that source before, rows of its first source, of its last)}, sources).

    One row a part reaches the driver, as the bounds of a range partitioning do; sources are counted where they are.
    """
    each = rows.groupBy(F.shiftright("at", 33).alias("part"), "source").agg(F.count(F.lit(1)).alias("n"))
    kind = F.struct(F.col("source").isNotNull().alias("is"), "source", "n")
    found = each.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min(kind).alias("a"), F.max(kind).alias("z")).orderBy("part").collect()
    rank, seen, last, totals, out = -1, 0, None, {}, {}
    for p in found:
        if last is None or (p["a"]["is"], p["a"]["source"]) != last:
            rank, seen = rank + 1, 0
        out[p["part"]] = (rank, seen, rank + p["k"] - 1)
        totals[rank] = totals.get(rank, 0) + p["a"]["n"]
        seen += p["a"]["n"]
        if p["k"] > 1:
            rank, seen = rank + p["k"] - 1, p["z"]["n"]
            totals[rank] = seen
        last = (p["z"]["is"], p["z"]["source"])
    return {k: (r, before, totals[r], totals[z]) for k, (r, before, z) in out.items()}, rank + 1


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in names}
    for b in batches:
        for c in names:
            out[c] += b.column(b.schema.get_field_index(c)).to_pylist()
    return out


def _keys(part: int, sources: list, at: dict[int, tuple], n_sources: int) -> tuple[list[Key], dict[int, int]]:
    """The leaf node of each row of a part, and the sizes of its trees."""
    rank, before, n_first, n_last = at[part]
    keys, sizes, start = [], {TOP: n_sources}, 0
    for i in range(1, len(sources) + 1):
        if i == len(sources) or sources[i] != sources[start]:
            skip = before if not start else 0
            keys += [(rank, 0, skip + j) for j in range(i - start)]
            sizes[rank] = n_first if not start else n_last if i == len(sources) else i - start
            rank, start = rank + 1, i
    return keys, sizes


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_NODES = pa.schema([("frag", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_PATHS = pa.schema([("frag", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.string())])
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def fragments(rows: DataFrame, parts: int, at: dict[int, tuple], n_sources: int) -> DataFrame:
    """The unresolved nodes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _columns(batches, ("part", "source", "leaf"))
        if x["part"]:
            keys, sizes = _keys(x["part"][0], x["source"], at, n_sources)
            nodes = close({k: d.hex() for k, d in zip(keys, x["leaf"], strict=True)}, sizes)
            yield _table([(x["part"][0], *k, sizes[k[0]], d) for k, d in nodes.items()], _NODES)

    part = F.shiftright("at", 33)
    dealt = rows.select(part.alias("part"), "at", "source", "leaf").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("at")
    return dealt.mapInArrow(run, NODE)


def _known(t: pa.Table) -> tuple[dict[Key, str], dict[int, int], dict[Key, int]]:
    x = t.to_pydict()
    keys = list(zip(x["tree"], x["level"], x["idx"], strict=True))
    return dict(zip(keys, x["digest"], strict=True)), dict(zip(x["tree"], x["n"], strict=True)), dict(zip(keys, x["frag"], strict=True))


def merged(nodes: DataFrame, n_sources: int) -> DataFrame:
    """FAN fragments at a time become one."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        nodes, sizes, _ = _known(t)
        sizes[TOP] = n_sources
        frag = key[0].as_py()
        return pa.Table.from_batches([_table([(frag, *k, sizes[k[0]], d) for k, d in merge(nodes, {}, sizes).items()], _NODES)])

    return nodes.groupBy(F.floor(F.col("frag") / FAN).alias("up")).applyInArrow(run, NODE)


def paths(nodes: DataFrame, upper: DataFrame, n_sources: int) -> DataFrame:
    """The way from each node of these fragments to the root, from the ways of the merged fragments' nodes."""

    def run(key: tuple, t: pa.Table, above: pa.Table) -> pa.Table:
        nodes, sizes, frag = _known(t)
        sizes[TOP] = n_sources
        x, up = above.to_pydict(), {}
        ends = {(a, b, c): heard(p) for a, b, c, p in zip(x["tree"], x["level"], x["idx"], x["path"], strict=True)}
        keys = list(nodes)
        merge(nodes, {}, sizes, up)
        return pa.Table.from_batches([_table([(frag[k], *k, said(steps(k, up, ends))) for k in keys], _PATHS)])

    left = nodes.groupBy(F.floor(F.col("frag") / FAN).alias("up"))
    return left.cogroup(upper.groupBy(F.col("frag").alias("up"))).applyInArrow(run, "frag long, tree long, level int, idx long, path string")


def tree_reduce(nodes: DataFrame, parts: int, n_sources: int) -> list[DataFrame]:
    """The fragments of every round; the last has one, the root alone."""
    out = [nodes]
    while parts > 1:
        out.append(written_small(merged(out[-1], n_sources), "manifest-nodes"))
        parts = -(-parts // FAN)
    return out


def proofs(rows: DataFrame, ways: DataFrame, parts: int, at: dict[int, tuple], n_sources: int, top: str) -> DataFrame:
    """Every row's proof, and the root folded from its (tampered) leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _columns(batches, ("part", "tree", "level", "idx", "path", "source", "doc_id", "leaf", "other"))
        if not x["part"]:
            return
        m = sum(p is not None for p in x["path"])
        ends = {k: heard(p) for k, p in zip(zip(x["tree"][:m], x["level"][:m], x["idx"][:m], strict=True), x["path"][:m], strict=True)}
        keys, sizes = _keys(x["part"][0], x["source"][m:], at, n_sources)
        above: dict[Key, tuple] = {}
        digests = [d.hex() for d in x["leaf"][m:]]
        close(dict(zip(keys, digests, strict=True)), sizes, above)
        out, known, upper = [], None, []
        for key, doc, mine, other in zip(keys, x["doc_id"][m:], digests, x["other"][m:], strict=True):
            if key in above:
                left, right, parent = above[key]
                if parent != known:
                    known, upper = parent, steps(parent, above, ends)
                path = [(left, right), *upper]
            else:
                path = ends[key]
            subroot = next(right for left, right in path if left is None)
            back = fold(other.hex() if other is not None else mine, path)
            out.append((doc, mine, subroot, top, h("".join(left + right for left, right in path if left is not None)), back, back == top))
            if len(out) == 4096:
                yield _table(out, _RESULT)
                out = []
        yield _table(out, _RESULT)

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    a = ways.select(F.col("frag").alias("part"), F.lit(-1).cast("long").alias("at"), "tree", "level", "idx", "path", *none("string", "source"), *none("long", "doc_id"), *none("binary", "leaf", "other"))
    b = rows.select(F.shiftright("at", 33).alias("part"), "at", *none("long", "tree"), *none("int", "level"), *none("long", "idx"), *none("string", "path"), "source", "doc_id", "leaf", "other")
    return a.union(b).repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("at").mapInArrow(run, RESULT)


def _built(docs: DataFrame, fields: tuple[str, ...], tampered: dict[str, Column] | None, part_rows: int) -> tuple:
    bounded(docs.sparkSession, 10_000)
    rows, parts = placed(written(leaves(docs, fields, tampered), "manifest-leaves"), part_rows)
    at, n = bearings(rows)
    rounds = tree_reduce(written(fragments(rows, parts, at, n), "manifest-nodes"), parts, n) if n else []
    return rows, parts, at, n, rounds


def root(docs: DataFrame, fields: tuple[str, ...] = FIELDS, part_rows: int = PART_ROWS) -> str | None:
    """The dataset's root; None for an empty table. Equal roots mean equal datasets, in any order of rows."""
    *_, rounds = _built(docs, fields, None, part_rows)
    return rounds[-1].first()["digest"] if rounds else None


def audit(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Callable[[DataFrame], dict[str, Column]] | None = stripped, part_rows: int = PART_ROWS) -> DataFrame:
    """A row a document: its leaf, subroot, root and proof, and whether the (tampered) row still folds to the root."""
    rows, parts, at, n, rounds = _built(docs, fields, tampered and tampered(docs), part_rows)
    if not n:
        return docs.sparkSession.createDataFrame([], RESULT)
    top = rounds[-1].first()["digest"]
    ways = rounds[-1].select("frag", "tree", "level", "idx", F.lit("").alias("path"))
    for nodes in reversed(rounds[:-1]):
        ways = paths(nodes, ways, n)
    return proofs(rows, ways, parts, at, n, top)
