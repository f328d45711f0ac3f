"""The documentation gate: links, reference definitions and anchors of a tree of Markdown files as a graph, with outlines and field blocks.

One reader a document keeps its order-dependent state (fences, repeated anchors, definitions that win by coming last) and gives rows; all that
crosses documents is joins: uses meet definitions by file and label, targets meet files by normalised path, anchors meet headings by
(file, anchor). A path is normalised by a stack that tells when it leaves the tree.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources import structured as X
from .batches import bounded
from . import gates as G
from .lineage import cut

ROWS = "file string, kind string, line int, label string, target string, path string, anchor string, level int"


def without_code(text: str) -> str:
    """Code spans replaced by blanks of their length."""
    return re.sub("`[^`]*`", lambda m: " " * len(m[0]), text)


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(target, place after the closing bracket) of what follows the opening one: an address, bare or in angle brackets, and perhaps a title."""
    n = len(text)

    def blanks(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    i = blanks(at)
    if text[i : i + 1] == "<" and ">" in text[i:]:
        stop = text.index(">", i) + 1
        target = text[i + 1 : stop - 1]
    else:
        stop = i
        while stop < n and not text[stop].isspace() and text[stop] not in "()":
            stop += 1
        target = text[i:stop]
    j = blanks(stop)
    if j > stop and text[j : j + 1] == '"':
        end = text.find('"', j + 1)
        if end < 0:
            return None
        j = blanks(end + 1)
    return (target, j + 1) if text[j : j + 1] == ")" else None


def bracketed(text: str, after: str) -> Iterator[tuple[str, int, int]]:
    """(label, place of its bracket, place after the mark) of labels in brackets that a mark follows directly."""
    i = text.find("[")
    while i >= 0:
        close = text.find("]", i + 1)
        if close < 0:
            return
        if text.startswith(after, close + 1):
            yield text[i + 1 : close], i, close + 1 + len(after)
        i = text.find("[", i + 1)


def inline_links(text: str) -> list[tuple[str, str]]:
    out, done = [], 0
    for label, start, at in bracketed(text, "("):
        found = destination(text, at) if start >= done else None
        if found:
            out.append((label, found[0]))
            done = found[1]
    return out


def reference_uses(text: str) -> list[tuple[str, str]]:
    """(text, label) of full and collapsed references; bare brackets are no links."""
    out, done = [], 0
    for label, start, at in bracketed(text, "["):
        end = text.find("]", at)
        if start >= done and end >= 0:
            out.append((label, (text[at:end].strip() or label.strip())))
            done = end + 1
    return out


def definition(text: str) -> tuple[str, str] | None:
    """(label, target) of a line that defines a reference."""
    bare = text.lstrip()
    if len(text) - len(bare) > 3 or not bare.startswith("["):
        return None
    label, mark, rest = bare[1:].partition("]:")
    target = rest.split(None, 1)[:1]
    if not mark or not label or "]" in label or not target:
        return None
    return label.strip(), target[0][1:-1] if target[0][0] == "<" and target[0][-1] == ">" else target[0]


def anchor_of(heading: str) -> str:
    """The anchor of a heading: links as their labels, marks dropped, blanks to hyphens."""
    out, done = [], 0
    for mark in ("(", "["):
        for label, start, at in list(bracketed(heading, mark)):
            end = heading.find(")" if mark == "(" else "]", at)
            if start >= done and end >= 0:
                cut_at = start - (start > 0 and heading[start - 1] == "!")
                out.append(heading[done:cut_at] + label)
                done = end + 1
        heading, out, done = "".join(out) + heading[done:], [], 0
    plain = "".join(c for c in heading if c not in "*~`" and c != "_").strip().lower()
    return "".join(c for c in plain if c in " _-" or unicodedata.category(c)[0] in "LN").replace(" ", "-")


def external(target: str) -> bool:
    return bool(re.match("(?i)([a-z][a-z0-9+.-]*:)?//|mailto:", target))


def _decoded(s: str) -> str:
    if "%" not in s or re.search("%(?![0-9A-Fa-f]{2})", s):
        return s
    try:
        return unquote_to_bytes(s).decode()
    except UnicodeDecodeError:
        return s


def read(text: str) -> list[tuple]:
    """(kind, line, label, target, path, anchor, level) of a document: heading, link, use, definition (the last of a label) and external."""
    out, defined, seen = [], {}, {}
    parts = lambda t: (_decoded(t.partition("#")[0]), _decoded(t.partition("#")[2]))
    for n, line, fenced, level, heading in X.parse_markdown(text.replace("\r\n", "\n")):
        if fenced:
            continue
        if level:
            base = anchor_of(heading)
            seen[base] = seen.get(base, -1) + 1
            out.append(("heading", n, heading, None, None, base if not seen[base] else f"{base}-{seen[base]}", level))
        plain = without_code(line)
        own = definition(plain)
        if own:
            defined[own[0].lower()] = ("definition", n, own[0].lower(), own[1], *parts(own[1]), None)
            continue
        for label, target in inline_links(plain):
            out.append(("external" if external(target) else "link", n, label, target, *parts(target), None))
        out += [("use", n, label.lower(), None, None, None, None) for _, label in reference_uses(plain)]
    return out + list(defined.values())


def rows(docs: DataFrame) -> DataFrame:
    """:func:`read` of documents (file, text), a row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(f, *r) for f, t in zip(b["file"], b["text"], strict=True) for r in read(t or "")]
            yield pd.DataFrame(found, columns=["file", "kind", "line", "label", "target", "path", "anchor", "level"])

    bounded(docs.sparkSession)
    return docs.select("file", "text").mapInPandas(run, ROWS)


def links(read_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets: file, line, target, path, anchor; undefined: file, line, label). Uses take their definition's target, definitions are checked as
    links of their own."""
    own = read_rows.filter("kind in ('link', 'definition')")
    uses = read_rows.filter("kind = 'use'").select("file", "line", "label")
    defined = read_rows.filter("kind = 'definition'").select("file", "label", "target", "path", "anchor")
    met = uses.join(defined.withColumn("known", F.lit(True)), ["file", "label"], "left")
    columns = ["file", "line", "target", "path", "anchor"]
    # a definition's address may be another site's; a use of it is then checked as any target is
    inner = own.filter((F.col("kind") == "link") | ~F.col("target").rlike("(?i)^(([a-z][a-z0-9+.-]*:)?//|mailto:)"))
    return inner.select(*columns).unionByName(met.filter("known").select(*columns)), met.filter("known is null").select("file", "line", "label")


def link_findings(read_rows: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, rule, severity, detail. docs: file; files: file of everything in the tree, whose folders exist too."""
    targets, undefined = links(read_rows)
    say = lambda d, rule, severity, detail: d.select("file", "line", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    empty = targets.filter(F.trim("target") == "")
    t = targets.filter(F.trim("target") != "")
    headings = read_rows.filter("kind = 'heading'").select(F.col("file").alias("to"), "anchor").distinct()
    here = t.filter("path = '' and anchor <> ''").withColumn("to", F.col("file"))
    away = t.filter("path <> '' and not startswith(path, '/')")
    folder = F.regexp_extract("file", "^(.*/)?[^/]*$", 1)
    away = away.withColumn("n", U.normal_path(F.concat(folder, "path"))).select("file", "line", "target", "path", "anchor", F.col("n.path").alias("to"), F.col("n.out").alias("out"))
    whole = files.select("file").unionByName(docs.select("file")).distinct()
    every = whole.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), F.lit(1), n), "/"))).alias("to")).distinct()
    inside = away.filter("not out")
    met = inside.join(every.withColumn("there", F.lit(True)), "to", "left")
    read_ = docs.select(F.col("file").alias("to")).distinct()
    asked = here.select("file", "line", "anchor", "to").unionByName(met.filter("there and anchor <> ''").join(read_, "to", "left_semi").select("file", "line", "anchor", "to"))
    out = say(empty, "link-empty", "error", F.lit("")).unionByName(say(undefined, "link-reference-undefined", "error", F.col("label")))
    out = out.unionByName(say(t.filter("startswith(path, '/')"), "link-absolute-path", "warning", F.col("path"))).unionByName(say(away.filter("out"), "link-escapes-repository", "error", F.col("path")))
    out = out.unionByName(say(met.filter("there is null"), "link-target-missing", "error", F.col("to")))
    return out.unionByName(say(asked.join(headings, ["to", "anchor"], "left_anti"), "link-anchor-missing", "warning", F.concat("to", F.lit("#"), "anchor")))


def audit(docs: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, rule, severity, detail of links, outlines and field blocks. docs: file, text of Markdown files; files: file of the whole tree.

    Null texts are empty documents. The line of a finding about a whole document is 0.
    """
    r = cut(rows(docs))
    names = docs.select("file").distinct()
    headings = r.filter("kind = 'heading'").select("file", "line", "level", F.col("label").alias("heading"), "anchor")
    outline = G.markdown(headings, names).select(F.col("at").alias("file"), F.coalesce(F.expr("try_cast(detail AS INT)"), F.lit(0)).alias("line"), F.col("check").alias("rule"), "severity", F.lit("").alias("detail"))
    lines = X.markdown_lines(docs.select("file", F.coalesce("text", F.lit("")).alias("text")))
    fields = G.metadata(lines).select("file", F.lit(0).alias("line"), F.col("code").alias("rule"), F.lit("error").alias("severity"), F.lit("").alias("detail"))
    return link_findings(r, names, files).unionByName(outline).unionByName(fields)
