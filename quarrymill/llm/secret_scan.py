"""Secret scans by corpus-wide ownership frequency, in DataFrame expressions only.

Candidates come from fixed patterns over whole texts. Each candidate value is hashed, and the hashes are aggregated
over the corpus by distinct repositories (a document stands for one, unless a column names them) and owners (``source``):
a value seen under many owners, or in many repositories of few owners, is a copied example; a value that few owners hold in few
repositories looks live. Candidates of the base kinds are always reported; candidates of the ``opaque`` kind (long mixed
runs) are reported only where the corpus says they are live-looking and where no base span overlaps them.

Defined cases: null text is the empty text (no spans); empty tables give empty results; repeated rows (even of one
doc_id) each keep their own result; a null source counts as one owner of its own, a null repository as one repository; further columns of the input are
ignored by :func:`scan` and kept by :func:`redact`, whatever their names. Texts of any length, with any number of hits, are scanned
whole in time that follows both. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spare, written

# The patterns of the base kinds and the least lengths of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
ASSIGN_LEAST = 12

#: A value held by more owners than this, or in more repositories, is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
MASK = "[SECRET]"
#: What stands for a copied example.
EXAMPLE = "[EXAMPLE]"

_SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"
#: Elements of a block; a list is folded in two levels, as a fold's state is copied at every step.
BLOCK = 64


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def _running(items: Column, value, both) -> Column:
    """array<struct<before:int,x>>: each item with the values of those before it, combined by both from 0 on."""
    folded = lambda block: F.aggregate(block, F.lit(0), lambda s, x: both(s, value(x)))

    def run(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, folded), F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(both(F.element_at(s, -1), t))))
        pairs = F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("s"))
        inner = lambda p: F.transform(p["b"], lambda x, i: F.struct(both(p["s"], folded(F.slice(p["b"], 1, i))).alias("before"), x.alias("x")))
        return F.flatten(F.transform(pairs, inner))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    return _let(_let(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(F.array())), run)


def _spans(text: Column, pattern: str, kind: str, order: int, group: int, may: Column) -> Column:
    """All leftmost non-overlapping matches with their code point offsets: the pieces between them give the offsets. may: a cheap
    condition that holds wherever the pattern is found."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), group) if group else hits).alias("value"))
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))

    def span(r: Column) -> Column:
        start = r["before"] + F.length(r["x"]["gap"])
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(r["x"]["hit"])).alias("end"), r["x"]["value"].alias("value"))

    found = F.transform(F.filter(_running(parts, size, lambda a, b: a + b), lambda r: r["x"]["hit"].isNotNull()), span)
    return F.when(may & text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, sorted by start and then by kind. ``{14,}`` and ``{16,}`` find what filtering maximal runs finds."""
    assign = F.filter(_spans(text, ASSIGN, "assign", 0, 2, text.contains("=") | text.contains(":")), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, "access", 1, 0, text.contains("AKIA")), _spans(text, HEX, "hex", 2, 0, F.lit(True))))


def opaque_spans(text: Column, base: Column) -> Column:
    """Long runs that mix digits, lower and upper case, apart from the base spans."""
    mixed = F.filter(_spans(text, OPAQUE, "opaque", 3, 0, F.lit(True)), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))

    # by the starts of base spans and the ends of opaque ones: a base span that starts before an opaque one's end must end by its start
    event = lambda x, at, own: F.struct(at.alias("at"), F.lit(own).alias("own"), x.alias("span"))
    events = F.array_sort(F.concat(F.transform(base, lambda x: event(x, x["start"], 1)), F.transform(mixed, lambda x: event(x, x["end"], 0))))
    top = _running(events, lambda e: F.when(e["own"] == 1, e["span"]["end"]).otherwise(F.lit(0)), F.greatest)
    apart = F.transform(F.filter(top, lambda r: (r["x"]["own"] == 0) & (r["before"] <= r["x"]["span"]["start"])), lambda r: r["x"]["span"])
    return F.when((F.size(base) == 0) | (F.size(mixed) == 0), mixed).otherwise(apart)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of one id and text, which have equal results."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", doc_id: str = "doc_id", repository: str | None = None) -> DataFrame:
    """One row per document: doc_id, owner, repository, base, opaque (span arrays), key (equal only for rows with equal results)."""
    name = F.col(repository or doc_id).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), name.alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "owner", "repository", "t", row_key(F.col("doc_id"), F.col("t")).alias("key"), base_spans(F.col("t")).alias("base"))
    return rows.select("doc_id", "owner", "repository", "base", opaque_spans(F.col("t"), F.col("base")).alias("opaque"), "key")


def ownership(cands: DataFrame) -> DataFrame:
    """(vhash, n_owners, n_repositories, n_uses) over the whole corpus. A hot value is summed by owner and repository before it moves."""
    each = cands.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("c")).select(F.sha2("c.value", 256).alias("vhash"), "owner", "repository")
    by_repository = each.groupBy("vhash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("vhash", "owner").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    return by_owner.groupBy("vhash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("m").alias("n_repositories"), F.sum("n").alias("n_uses"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", doc_id: str = "doc_id", max_owners: int = MAX_OWNERS, repository: str | None = None, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per input row: doc_id, key, base (spans), found (all reported spans), n_live, n_example, n_repositories (of the value
    that most of them hold)."""
    cands = written(candidates(docs, text, owner, doc_id, repository), "secret-candidates")
    held = ownership(cands)
    # repeated rows share a key and a result
    each = cands.filter(F.size("base") + F.size("opaque") > 0).select("key", F.explode(F.concat("base", "opaque")).alias("c")).select("key", "c", F.sha2("c.value", 256).alias("vhash"))
    judged = each.join(held, "vhash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    kept = judged.filter((F.col("c.ord") < 3) | F.col("live"))
    by_row = kept.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("c.start", "c.ord", "c.kind", "c.end", "c.value", "live"))).alias("found"), F.max("n_repositories").alias("n_repositories"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string,live:boolean>>")
    out = cands.join(by_row, "key", "left").withColumn("found", F.coalesce("found", none))
    return out.select(
        "doc_id", "key", "base", "found",
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
        F.coalesce("n_repositories", F.lit(0).cast("long")).alias("n_repositories"),
    )


def report(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"), "n_live", "n_example", "n_repositories")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced, by ``MASK`` or, where no live span takes part, by ``EXAMPLE``; of overlapping spans one mask stays."""
    top = _running(spans, lambda x: x["end"], F.greatest)
    told = _running(top, lambda r: r["x"]["live"].cast("int"), lambda a, b: a + b)  # before: live spans before; x.before: the furthest end before
    last = F.array(F.struct(F.aggregate(spans, F.lit(0), lambda s, x: s + x["live"].cast("int")).alias("before"), F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("before"), F.element_at(spans, -1).alias("x")).alias("x")))
    heads = F.concat(F.filter(told, lambda r: r["x"]["before"] <= r["x"]["x"]["start"]), last)

    def joined(h: Column) -> Column:
        """From each head to the next: one span."""
        one = lambda i: F.struct(F.get(h, i)["x"]["x"]["start"].alias("start"), F.get(h, i + 1)["x"]["before"].alias("end"), (F.get(h, i + 1)["before"] > F.get(h, i)["before"]).alias("live"))
        return F.transform(F.sequence(F.lit(0), F.size(h) - 2), one)

    def all_masked(m: Column) -> Column:
        """In pieces of ``BLOCK`` spans: a piece is cut from the text once, and its gaps from the piece."""
        end = lambda i: F.coalesce(F.get(m, i)["end"], F.lit(0))

        def piece(b: Column) -> Column:
            own, start = F.slice(m, b * BLOCK + 1, BLOCK), end(b * BLOCK - 1)
            raw = F.substring(text, start + 1, F.element_at(own, -1)["end"] - start)

            def cut(raw: Column) -> Column:
                def gap(x: Column, i: Column) -> Column:
                    before = F.coalesce(F.get(own, i - 1)["end"], start)
                    return F.concat(F.substring(raw, before - start + 1, x["start"] - before), F.when(x["live"], F.lit(MASK)).otherwise(F.lit(EXAMPLE)))

                return F.array_join(F.transform(own, gap), "")

            return _let(raw, cut)

        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), piece)
        return F.concat(F.array_join(pieces, ""), F.substring(text, end(F.size(m) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_let(heads, joined), all_masked))


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The documents with every reported span masked, live ones and copied examples by marks of their own; columns as before, n_chars counted anew where a text changed.

    The patterns run once; the decisions, a small share of the rows, are joined back by key.
    """
    cols = docs.columns
    key, hits = spare(cols, "key", "hits")
    found = scan(docs, max_owners=max_owners).filter(F.size("found") > 0).select(F.col("key").alias(key), F.col("found").alias(hits)).dropDuplicates([key])
    rows = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(found, key, "left")
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(mask(F.coalesce(F.col("text"), F.lit("")), F.col(hits)))
    rows = rows.withColumn("text", text)
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.when(F.col(hits).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*[F.col(f"`{c}`") for c in cols])
