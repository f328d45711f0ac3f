"""The conversation trie against a trie built by force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from quarrymill.llm import oracles, prefix_trie
from tests.llm.test_llm import DATA
from tests.test_oracles import rows as shown

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, `key` string, salt string"


def spliced(table):
    """{conv: [(role, text)]} as the contract rebuilds them. table: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def by_force(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = {}
    for path in sorted(members, key=len, reverse=True):
        below = [found[p] for p in children[path]]
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        found[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(path))
        out.append((cs[0], len(path), members[path[:-1]][0] if path else None, len(cs), len(children[path]), *found[path], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def trie(df):
    return Counter(tuple(r) for r in prefix_trie.build(*prefix_trie.spliced(prefix_trie.turns(df))).collect())


def test_trie_by_force(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert trie(df) == by_force(spliced([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def hostile(spark):
    data = []
    for c in range(100, 160):  # copies and near copies, some long
        data += [(c, t, "user", f"t{t}" * (t + 1)) for t in range(30 if c % 7 else 26)]
        data += [(c, 40, "assistant", "end" if c % 3 else f"end {c}")]
    data += [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (None, 1, "user", "lost"), (-5, 1, "a", "x"), (-105, 1, "a", "é" * 9), (205, 1, "u", "alone"), (260, 1, "u", "one"), (261, 1, None, "one"), (262, None, "u", "x" * 100_000)]
    data += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(3)]
    return spark.createDataFrame([(*r, "c", 1, "k", "s") for r in data], SCHEMA)


def test_trie_on_hostile_rows(spark):
    df = hostile(spark)
    table = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = by_force(spliced(table))
    assert trie(df.repartition(3)) == want
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.build(*prefix_trie.spliced(prefix_trie.turns(df))).toPandas()[names]
    assert shown(got.astype({"parent_conv_id": "Int64"})) == shown(con.execute(oracles.SQL["op13_conversation_trie"]).df()[names].astype({"parent_conv_id": "Int64"}))


def test_levels_end_where_nothing_branches(spark):
    """A thousand turns that two conversations share whole take one level."""
    rows = [(c, t, "user", f"t{t}") for c in (300, 400) for t in range(1000)]
    convs, turns = prefix_trie.spliced(prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    _, _, held = prefix_trie.levels(convs, prefix_trie.remaining(turns))
    assert len(held) == 1


def test_many_ends_are_packed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    ends = spark.range(100).select(F.lit(2).cast("long").alias("depth"), (F.col("id") % 3).alias("head"), F.col("id").alias("conv"))
    want = {h: hashlib.sha256(",".join(str(c) for c in range(100) if c % 3 == h).encode()).hexdigest() for h in range(3)}
    assert {r["head"]: r["ends_sha256"] for r in prefix_trie.digests(ends).collect()} == want


def test_trie_of_nothing(spark):
    assert not trie(spark.createDataFrame([], SCHEMA))
    assert not trie(spark.createDataFrame([(None, 1, "a", "b", "c", 1, "k", "s")], SCHEMA))
    assert trie(spark.createDataFrame([(3, 1, "a", "b", "c", 1, "k", "s")], SCHEMA)) == by_force(spliced([(3, 1, "a", "b")]))
