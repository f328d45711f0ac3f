"""The dataset manifest against a Merkle tree built by force, over parts of a few rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import manifest
from tests.llm.test_llm import DATA, hostile, nothing


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    """(root, [siblings of each leaf, upwards])."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 3
            run = nodes[first : first + 3]
            paths[leaf].append((run[: i - first], run[i - first + 1 :]))
            at[leaf] = i // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def by_force(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        doc, source, lang, n, text = r
        other = text
        if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None:
            other = text.replace("\n", "")
        sources.setdefault(source, []).append((doc is not None, doc or 0, sha("".join(map(said, r))), sha("".join(map(said, (doc, source, lang, n, other)))), doc))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s])]) for s in names}
    root, upper = levels([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for x, path in zip(sorted(sources[s]), trees[s][1], strict=True):
            whole, back = path + upper[k], x[3]
            for left, right in whole:
                back = sha("".join(left) + back + "".join(right))
            out.append((x[4], x[2], trees[s][0], root, sha("".join(d for left, right in whole for d in left + right)), back, back == root))
    return Counter(out)


FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def check(docs, part_rows):
    want = by_force([tuple(r) for r in docs.select(*FIELDS).collect()])
    assert Counter(tuple(r) for r in manifest.audit(docs, part_rows=part_rows).collect()) == want
    return want


@pytest.mark.parametrize("part_rows", [manifest.PART_ROWS, 7])
def test_manifest_by_force(spark, part_rows):
    want = check(spark.read.parquet(f"{DATA}/documents.parquet"), part_rows)
    assert {True, False} == {k[-1] for k in want}  # some rows are tampered with, some are not


def test_manifest_on_hostile_rows(spark):
    check(hostile(spark), 3)
    check(hostile(spark).withColumn("source", F.lit(None).cast("string")), 2)
    check(hostile(spark).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))), 4)
    check(hostile(spark).limit(1), 4)


def test_manifest_of_many_sources_and_one_hot(spark):
    rows = [(i, "hot" if i % 3 else f"s{i}", None, i, "a\nb") for i in range(700)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), 20)
    same = [(7, "s", "en", 3, "a\nb")] * 200
    check(spark.createDataFrame(same, "doc_id long, source string, lang string, n_chars long, text string"), 20)


def test_manifest_of_nothing(spark):
    assert manifest.audit(nothing(spark)).collect() == []
    assert manifest.root(nothing(spark)) is None


def test_root_does_not_depend_on_order_or_parts(spark):
    docs = hostile(spark)
    assert len({manifest.root(docs, part_rows=3), manifest.root(docs.orderBy(F.desc("text"))), manifest.root(docs.repartition(5), part_rows=11)}) == 1
    assert manifest.root(docs.filter("doc_id <> 8")) != manifest.root(docs)


def test_fragments_are_a_monoid():
    """Merging fragments in any order and grouping gives the same fragment, and the root at the end."""
    rnd = random.Random(5)
    for n in (1, 2, 3, 4, 9, 10, 28, 82):
        leaves = [sha(str(i)) for i in range(n)]
        sizes = {0: n, manifest.TOP: 1}
        for _ in range(20):
            frags = [{(0, 0, i): x} for i, x in enumerate(leaves)]
            while len(frags) > 1:
                a = frags.pop(rnd.randrange(len(frags)))
                b = frags.pop(rnd.randrange(len(frags)))
                frags.append(manifest.merge(a, b, sizes))
            assert manifest.merge(frags[0], {}, sizes) == {(manifest.TOP, 0, 0): levels(leaves)[0]}
