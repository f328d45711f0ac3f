"""The documentation gate over a tree of Markdown made from the documents: headings from their first lines, links between neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as D
from . import bridge as B
from .bridge import oracle as o
from .registry import query


def _docs(spark, d):
    """file, text: a title, links to the next document (with its anchor, a wrong one, none, or to no file), out of the tree and from its root, references with and without definition, a fence."""
    lit, i = F.lit, F.col("doc_id")
    t = B.table(spark, d, "documents").select("doc_id", F.concat(lit("T "), F.trim(F.regexp_replace(F.left(F.split(F.coalesce("text", lit("")), "\n", 2)[0], lit(30)), "[^A-Za-z0-9 ]", ""))).alias("title"))
    t = t.withColumn("title", F.trim(F.regexp_replace("title", " +", " ")))
    file = lambda k: F.concat(lit("d"), (k % 5).cast("string"), lit("/"), k.cast("string"), lit(".md"))
    after = t.select((i - 1).alias("doc_id"), F.replace(F.lower("title"), lit(" "), lit("-")).alias("next_anchor"))
    t = t.join(after, "doc_id", "left")
    link = F.when(i % 4 == 3, "../none/x.md").otherwise(F.concat(lit("../"), file(i + 1), F.when(i % 4 == 0, F.concat(lit("#"), F.coalesce("next_anchor", lit("")))).when(i % 4 == 1, "#nowhere").otherwise("")))
    own = F.when(i % 5 == 0, "[r2]: <../gone/x.md>").otherwise(F.concat(lit("[R1]: ./"), i, lit(".md#"), F.replace(F.lower("title"), lit(" "), lit("-"))))
    text = F.concat_ws(
        "\n", F.concat(lit("# "), "title"), F.concat(lit("[next]("), link, lit(")")), F.concat(lit("[abs](/root/"), i, lit(".md) and [out](../../"), i, lit(".md) `[code](no.md)` [ext](https://x.example/) []()")),
        F.concat(lit("[use][r"), (i % 3).cast("string"), lit("] and [r1][]")), own, lit("```\n[in fence](no.md)\n```"),
    )
    return t.select(file(i).alias("file"), text.alias("text"))


_F = "'d' || ({i}) % 5 || '/' || ({i}) || '.md'"
_DOCS = rf"""
dt AS MATERIALIZED (SELECT doc_id AS i, trim(regexp_replace('T ' || trim(regexp_replace(left(string_split(coalesce(text, ''), chr(10))[1], 30), '[^A-Za-z0-9 ]', '', 'g')), ' +', ' ', 'g')) AS title FROM documents),
dd AS MATERIALIZED (SELECT i, {_F.format(i="i")} AS file, replace(lower(title), ' ', '-') AS anchor FROM dt),
nx AS (SELECT a.file, a.i, b.file AS to_, b.anchor AS right_ FROM dd a LEFT JOIN dd b ON b.i = a.i + 1),
df AS (SELECT file, 2 AS line, 'link-target-missing' AS rule, 'error' AS severity, 'none/x.md' AS detail FROM nx WHERE i % 4 = 3
  UNION ALL SELECT file, 2, 'link-target-missing', 'error', {_F.format(i="i + 1")} FROM nx WHERE i % 4 < 3 AND to_ IS NULL
  UNION ALL SELECT file, 2, 'link-anchor-missing', 'warning', to_ || '#nowhere' FROM nx WHERE i % 4 = 1 AND to_ IS NOT NULL AND right_ <> 'nowhere'
  UNION ALL SELECT file, 3, 'link-absolute-path', 'warning', '/root/' || i || '.md' FROM dd UNION ALL SELECT file, 3, 'link-escapes-repository', 'error', '../../' || i || '.md' FROM dd UNION ALL SELECT file, 3, 'link-empty', 'error', '' FROM dd
  UNION ALL SELECT file, 4, 'link-reference-undefined', 'error', 'r' || i % 3 FROM dd WHERE NOT (i % 5 = 0 AND i % 3 = 2 OR i % 5 > 0 AND i % 3 = 1) UNION ALL SELECT file, 4, 'link-reference-undefined', 'error', 'r1' FROM dd WHERE i % 5 = 0
  UNION ALL SELECT file, 4, 'link-target-missing', 'error', 'gone/x.md' FROM dd WHERE i % 5 = 0 AND i % 3 = 2 UNION ALL SELECT file, 5, 'link-target-missing', 'error', 'gone/x.md' FROM dd WHERE i % 5 = 0)"""


@query("j19_docs_links", o(f", {_DOCS} SELECT * FROM df"))
def j19(spark, d):
    t = _docs(spark, d)
    return D.link_findings(D.cut(D.rows(t)), t.select("file"), t.select("file"))


@query("g15_docs_gate", o(f", {_DOCS} SELECT * FROM df UNION ALL SELECT file, 0, 'meta-block-missing', 'error', '' FROM dd"))
def g15(spark, d):
    t = _docs(spark, d)
    return D.audit(t, t.select("file"))


@query("x14_docs_links", o(f""", {_DOCS} SELECT file, 'external' AS kind, 3 AS line, 'https://x.example/' AS target FROM dd UNION ALL SELECT file, 'link', 2, CASE WHEN i % 4 = 3 THEN '../none/x.md' ELSE '../' || {_F.format(i="i + 1")} || CASE i % 4 WHEN 0 THEN '#' || coalesce(right_, '') WHEN 1 THEN '#nowhere' ELSE '' END END FROM nx
UNION ALL SELECT file, 'link', 3, '/root/' || i || '.md' FROM dd UNION ALL SELECT file, 'link', 3, '../../' || i || '.md' FROM dd UNION ALL SELECT file, 'link', 3, '' FROM dd
UNION ALL SELECT file, 'definition', 5, CASE WHEN i % 5 = 0 THEN '../gone/x.md' ELSE './' || i || '.md#' || anchor END FROM dd"""))
def x14(spark, d):
    """Every link of every document, none left out."""
    return D.rows(_docs(spark, d)).filter("kind in ('link', 'external', 'definition')").select("file", "kind", "line", "target")
