"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame expressions only.

A text is cut into sections (blank lines), paragraphs (lines) and pieces of ``PIECE`` code points. A piece's node is its
MD5; a paragraph's node digests its pieces' nodes, a section's its paragraphs', the root its sections'. The fingerprint is
the tree with its nodes below the root shortened to eight digits: ``root:section=paragraph+piece,piece;paragraph+.../section=...``.
Equal texts have equal fingerprints, equal roots mean equal texts, and :func:`differing` locates edits by descending from
sections that differ to their paragraphs that differ. Likeness is the share of pieces that two trees have in common.

Defined cases: null text is the empty text, whose fingerprint has no pieces; two empty texts are alike (1.0), an empty and
another text are not (0.0); null doc_ids come before all others in the order of documents; rows of one doc_id are ordered by
their text's MD5, repeated rows each get a row; a single document is its own next one; an empty table gives an empty result;
further columns are ignored. doc_ids may be any integers, hashes too. Texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a leaf.
PIECE = 32
#: Rows of a bucket in the order of ids, about.
BUCKET_ROWS = 1024
#: Quantiles of the ids that reach the driver.
QUANTILES = 1000


def tree(text: Column) -> Column:
    """array (sections) of arrays (paragraphs) of arrays (pieces) of digests."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE}}}"), 0), lambda x: F.md5(x))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), pieces))


def paragraph_node(p: Column) -> Column:
    return F.md5(F.array_join(p, ""))


def let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def fingerprint(t: Column) -> Column:
    """The string form of a tree; every node is digested once."""
    short = lambda x: F.substring(x, 1, 8)

    def section(s: Column) -> Column:
        def said(nodes: Column) -> Column:
            paragraphs = F.zip_with(s, nodes, lambda p, n: F.concat(short(n), F.lit("+"), F.array_join(F.transform(p, short), ",")))
            return F.struct(F.md5(F.array_join(nodes, "")).alias("node"), F.array_join(paragraphs, ";").alias("said"))

        return let(F.transform(s, paragraph_node), said)

    root = lambda x: F.md5(F.array_join(F.transform(x, lambda y: y["node"]), ""))
    return let(F.transform(t, section), lambda x: F.concat(root(x), F.lit(":"), F.array_join(F.transform(x, lambda y: F.concat(short(y["node"]), F.lit("="), y["said"])), "/")))


def leaves(fp: Column) -> Column:
    """Distinct pieces of a fingerprint."""
    pieces = F.transform(F.split(F.substring_index(fp, ":", -1), "[,;/]", -1), lambda x: F.substring_index(x, "+", -1))
    return F.array_distinct(F.filter(pieces, lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared of all leaves of two arrays from :func:`leaves`, 0 to 1."""
    both, n = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(both.cast("double") / (n - both))


def differing(a: Column, b: Column) -> Column:
    """Where the trees of two fingerprints differ: (section, paragraph) numbers from 0. Sections with equal nodes are not entered."""
    node = lambda x, i: F.substring(F.get(x, i), 1, 8)
    apart = lambda x, y: F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: ~node(x, i).eqNullSafe(node(y, i)))
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    sections = lambda fp: F.split(F.substring_index(fp, ":", -1), "/", -1)
    below = lambda x, i: F.coalesce(F.split(F.substring(F.get(x, i), 10, 1 << 30), ";", -1), F.array().cast("array<string>"))

    def inside(p: Column, i: Column) -> Column:
        return F.transform(let(pair(below(p["a"], i), below(p["b"], i)), lambda q: apart(q["a"], q["b"])), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    places = let(pair(sections(a), sections(b)), lambda p: F.flatten(F.transform(apart(p["a"], p["b"]), lambda i: inside(p, i))))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(places)


def _successors(heads: DataFrame, last: int) -> DataFrame:
    """(bucket, next_): the bucket that follows, after the last the first. In two levels, so that no window holds all of them."""
    t = heads.select("bucket").withColumn("g_", F.floor(F.col("bucket") / F.lit(last // 4096 + 1)))
    inner = t.withColumn("next_", F.lead("bucket").over(Window.partitionBy("g_").orderBy("bucket")))
    firsts = t.groupBy("g_").agg(F.min("bucket").alias("head_"))  # 4096 rows at most
    w = Window.partitionBy(F.lit(0)).orderBy("g_")
    firsts = firsts.select("g_", F.coalesce(F.lead("head_").over(w), F.first("head_").over(w)).alias("after_"))
    return inner.join(firsts, "g_").select("bucket", F.coalesce("next_", "after_").alias("next_"))


def bucket_of(doc_id: Column, digest: Column, cuts: list[int], n: int, bucket_rows: int) -> tuple[Column, int]:
    """(bucket, greatest bucket possible): numbers that never fall in the order of (doc_id, digest), nulls first.

    cuts are sorted quantiles of the ids. Between two of them buckets have equal widths (of ids as doubles: the order never turns
    round). An id that is the value of several quantiles, and null, are divided by the digest.
    """
    b = max(1, -(-n // bucket_rows))
    each = max(1, -(-b // max(1, len(cuts))))
    kinds = sorted(set(cuts))
    hot = [c for c in kinds if cuts.count(c) > 1]
    by_digest = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(b) / F.lit(1 << 32)).cast("long")
    if not kinds:
        return by_digest, b
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    rows = [kinds[i : i + 32] for i in range(0, len(kinds), 32)]
    heads, table = longs([r[0] for r in rows]), F.array(*[longs(r) for r in rows])
    span = b + each
    lows = longs([kinds[0], *kinds])
    widths = F.array(*[F.lit(max(1.0, (float(y) - float(x)) / each)) for x, y in zip([kinds[0], *kinds], [*kinds, kinds[-1]], strict=True)])
    at_most = lambda xs: F.size(F.filter(xs, lambda c: c <= doc_id))
    rank = let(F.greatest(at_most(heads) - 1, F.lit(0)), lambda row: row * 32 + at_most(F.get(table, row)))  # from 0, below all cuts
    even = lambda j: F.least(F.greatest(F.floor((doc_id.cast("double") - F.get(lows, j).cast("double")) / F.get(widths, j)), F.lit(0)), F.lit(each - 1)).cast("long")
    split = F.array_contains(longs(hot), doc_id) if hot else F.lit(False)
    known = let(rank, lambda j: (j + 1).cast("long") * span + F.when(split, by_digest).otherwise(F.lit(b) + even(j)))
    # never null: a filter for that would part plans that share an exchange
    return F.coalesce(F.when(doc_id.isNull(), by_digest).otherwise(known), F.lit(0).cast("long")), (len(kinds) + 2) * span


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp) in ascending doc_id, after the last the first.

    Texts move once: by the bucket of their id. Within a bucket a window finds the next row; the last of a bucket takes
    the first of the bucket that follows, which is a join of one row a bucket.
    """
    r = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 4 * QUANTILES)).first()
    # no alias where none is needed: it would part plans that share an exchange
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    d = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text")).withColumn("md", F.md5("text"))
    bucket, last = bucket_of(F.col("doc_id"), F.col("md"), [int(x) for x in r[1] or []], r[0], bucket_rows)
    d = d.withColumn("bucket", bucket)
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "md")
    heads = d.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").select("bucket", "text")
    after = _successors(d.select("bucket").distinct(), last)
    follow = after.join(heads.select(F.col("bucket").alias("next_"), F.col("text").alias("next_text"), fingerprint(tree(F.col("text"))).alias("next_fp")), "next_").drop("next_")
    t = d.withColumn("fp", fingerprint(tree(F.col("text")))).withColumn("next_", F.lead(F.struct("text", "fp")).over(w))
    inside = t.filter(F.col("next_").isNotNull()).select("doc_id", "text", "fp", F.col("next_.text").alias("next_text"), F.col("next_.fp").alias("next_fp"))
    ends = t.filter(F.col("next_").isNull()).select("bucket", "doc_id", "text", "fp").join(follow, "bucket").drop("bucket")
    return inside.unionByName(ends)


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, how alike they are, and how many paragraphs the edit touches by the trees."""
    t = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    t = t.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"), "next_fp")
    t = t.withColumn("l_", leaves(F.col("fingerprint")))
    return t.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("l_"), leaves(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("l_"), leaves(F.col("next_fp"))).alias("near_next"),
        F.size(differing(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("long").alias("n_differing"),
    )
