"""The accessibility audit on the pages' own markup, and what their style sheets say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accessibility as A
from ..operators import css as C
from . import bridge as B
from .bridge import oracle as o
from .registry import query

#: Sheets that pages apply in turn: one with the universal rule, one with rules of classes under conditions, one that takes outlines away, none.
SHEETS = (
    ":focus-visible{outline:2px solid} :root{--color-ink:#111111;--color-paper:snow}",
    "/* .no:focus-visible{outline:1px} */ @media (min-width:1px){.skip-link:focus-visible,.btn:focus-visible{border-color:red}} ul{list-style:none}",
    ".skip-link:focus-visible{outline:none} .m{display:flex} :root{--color-dim:#cccccc}",
    "",
)
FACTS = [(0, "universal", "*"), (1, "focus", "skip-link"), (1, "indicator", "skip-link"), (1, "focus", "btn"), (1, "indicator", "btn"), (1, "list-tag", "ul@*"), (2, "focus", "skip-link"), (2, "list-class", "m")]
PAIRS = [("ink-paper", "ink", "paper", "text"), ("dim-paper", "dim", "paper", "large"), ("gone", "none", "paper", "text")]
_MORE = {
    0: '<a class="skip-link" href="#main">s</a><main id="main">x</main>',
    1: '<main id="main" tabindex="-1">x</main><a class="skip-link" href="#main">s</a><input type="checkbox" id="t"><label for="t">m</label>',
    2: '<header></header><input type="checkbox" id="u" checked>',
}
_TAIL = {
    0: '<nav aria-label="Main"><a href="/" aria-current="page">h</a></nav><nav aria-label="Main"></nav>',
    1: '<button class="btn big">b</button><ul class="m"><li>x</ul><ul role="list" class="m"></ul>',
    2: '<section id="s"><h2 id="s-title">t</h2></section><section aria-labelledby="gone"></section>',
    3: "<h4>deep</h4><summary>y</summary>",
}


def _pages(spark, d):
    """file, html, css: pages with what the test markup lacks, each under one of the sheets."""
    pick = lambda by, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.col("page_id") % by + 1).cast("int"))
    t = B.pages(spark, d).select("page_id", "html")
    return t.select(F.concat("page_id", F.lit("/index.html")).alias("file"), F.concat("html", pick(3, _MORE.values()), pick(4, _TAIL.values())).alias("html"), pick(4, SHEETS).alias("css"))


_CASE = lambda by, of: f"(CASE page_id % {by} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in of.items()) + " END)"
_PAGES = f"""
ap AS MATERIALIZED (SELECT page_id, page_id || '/index.html' AS file, html || {_CASE(3, _MORE)} || {_CASE(4, _TAIL)} AS h, page_id % 4 AS s FROM pages),
fx AS (SELECT * FROM (VALUES {", ".join(f"({s}, '{k}', '{n}')" for s, k, n in FACTS)}) t(s, kind, name)),
ct AS (SELECT file, s, unnest(regexp_extract_all(h, '<((?:a|button|summary)\\b[^>]*)>', 1)) AS t FROM ap),
cl AS (SELECT file, s, regexp_extract(t, '^[a-z]+') AS tag, list_filter(string_split(regexp_extract(t, '\\sclass="([^"]*)"', 1), ' '), lambda c: c <> '') AS cs FROM ct WHERE NOT (starts_with(t, 'a ') OR t = 'a') OR regexp_matches(t, '\\shref="')),
ls AS (SELECT file, s, unnest(regexp_extract_all(h, '<((?:ul|ol)\\b[^>]*)>', 1)) AS t FROM ap),
ll AS (SELECT file, s, regexp_extract(t, '^[a-z]+') AS tag, list_filter(string_split(regexp_extract(t, '\\sclass="([^"]*)"', 1), ' '), lambda c: c <> '') AS cs, regexp_extract(t, '\\srole="([^"]*)"', 1) AS role FROM ls),
shapes AS (SELECT DISTINCT 'focus' AS check_, file, array_to_string(list_prepend(tag, cs), '.') AS shape FROM cl WHERE s <> 0 AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.s = cl.s AND kind = 'indicator' AND list_contains(cs, name))
  UNION SELECT DISTINCT 'lists', file, array_to_string(list_prepend(tag, cs), '.') FROM ll WHERE role <> 'list' AND EXISTS (SELECT 1 FROM fx WHERE fx.s = ll.s AND (kind = 'list-class' AND list_contains(cs, name) OR kind = 'list-tag' AND name = tag || '@*'))),
nv AS (SELECT file, list_transform(regexp_extract_all(h, '<nav(?:\\s[^>]*)?>'), lambda t: nullif(regexp_extract(t, 'aria-label="([^"]*)"', 1), '')) AS navs, h, page_id, list_transform(regexp_extract_all(h, '(?i)<h([1-6])\\b', 1), lambda x: x::INT) AS lv FROM ap)"""


@query("x09_style_index", o(f", {_PAGES}, used AS (SELECT DISTINCT s FROM ap) SELECT s.css_len AS css_length, kind, name FROM (VALUES {', '.join(f'({i}, {len(c)})' for i, c in enumerate(SHEETS))}) s(s, css_len) JOIN used USING (s) JOIN fx USING (s)"))
def x09(spark, d):
    sheets = C.sheets_of(_pages(spark, d))
    return C.index(sheets).join(sheets.select("sheet", F.length("css").alias("css_length")), "sheet").select("css_length", "kind", "name")


@query("a23_style_shapes", o(f", {_PAGES} SELECT check_ AS \"check\", shape AS key, count(*) || ' pages, as ' || min(file) AS detail FROM shapes GROUP BY check_, shape"))
def a23(spark, d):
    p = _pages(spark, d)
    return A.style_findings(A.read(p), C.index(C.sheets_of(p))).filter("at = '*'").select("check", "key", "detail")


@query("g04_accessibility", o(f""", {_PAGES},
pf AS (SELECT file AS "at", 'landmarks' AS "check", 'missing-landmark' AS key FROM nv WHERE NOT regexp_matches(h, '<header(\\s|>)') UNION ALL SELECT file, 'landmarks', 'missing-landmark' FROM nv WHERE NOT regexp_matches(h, '<main(\\s|>)') UNION ALL SELECT file, 'landmarks', 'missing-landmark' FROM nv WHERE NOT regexp_matches(h, '<footer(\\s|>)')
  UNION ALL SELECT file, 'landmarks', 'unnamed-nav' FROM nv WHERE len(list_filter(navs, lambda x: x IS NULL)) > 0 UNION ALL SELECT file, 'landmarks', 'duplicate-nav-name' FROM nv WHERE len(list_filter(navs, lambda x: x IS NOT NULL)) > len(list_distinct(list_filter(navs, lambda x: x IS NOT NULL)))
  UNION ALL SELECT file, 'skip-link', 'unfocusable:main' FROM nv WHERE page_id % 3 = 0 UNION ALL SELECT file, 'navigation', 'no-nav' FROM nv WHERE len(navs) = 0 UNION ALL SELECT file, 'navigation', 'disclosure' FROM nv WHERE len(navs) > 0 AND page_id % 3 = 0
  UNION ALL SELECT file, 'navigation', 'summary' FROM nv WHERE len(navs) > 0 AND page_id % 3 = 2 UNION ALL SELECT file, 'navigation', 'toggle-open' FROM nv WHERE len(navs) > 0 AND page_id % 3 = 2
  UNION ALL SELECT file, 'navigation', 'current-mismatch' FROM nv WHERE page_id % 4 = 0
  UNION ALL SELECT file, 'landmarks', 'unnamed-section:s' FROM nv WHERE page_id % 4 = 2 UNION ALL SELECT file, 'landmarks', 'dangling-name:gone' FROM nv WHERE page_id % 4 = 2
  UNION ALL SELECT file, 'focus', 'system-rule' FROM ap WHERE s <> 0
  UNION ALL SELECT file, 'headings', 'no-h1' FROM nv WHERE NOT list_contains(lv, 1) UNION ALL SELECT file, 'headings', 'multiple-h1 ' || len(list_filter(lv, lambda x: x = 1)) FROM nv WHERE len(list_filter(lv, lambda x: x = 1)) > 1
  UNION ALL SELECT file, 'headings', 'starts-below-h1 ' || lv[1] FROM nv WHERE len(lv) > 0 AND lv[1] <> 1
  UNION ALL SELECT file, 'headings', 'skipped-level ' || lv[i - 1] || '>' || lv[i] FROM (SELECT file, lv, unnest(range(2, len(lv) + 1)) AS i FROM nv) WHERE lv[i] > lv[i - 1] + 1),
nl AS (SELECT DISTINCT file, href FROM (SELECT file, unnest(regexp_extract_all(r, '<a\\b[^>]*\\shref="([^"]*)"', 1)) AS href FROM (SELECT file, unnest(regexp_extract_all(h, '(?s)<nav\\b[^>]*>(.*?)</nav>', 1)) AS r FROM ap)) WHERE NOT regexp_matches(href, '^(https?:|mailto:|tel:|#)')),
nf AS (SELECT file, href, regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '^/', '') AS c FROM nl),
cn AS (SELECT * FROM (VALUES ('contrast', 'dim-paper', 1.55), ('contrast', 'missing-token:gone', NULL)) t(c, k, r))
SELECT 'error' AS severity, "check", "at", key AS detail FROM pf
UNION ALL SELECT 'error', check_, '*', shape || ' ' || count(*) || ' pages, as ' || min(file) FROM shapes GROUP BY check_, shape
UNION ALL SELECT 'error', 'navigation', file, 'dead:' || href FROM nf WHERE (CASE WHEN c = '' THEN 'index.html' WHEN c LIKE '%.html' THEN c ELSE regexp_replace(c, '/$', '') || '/index.html' END) NOT IN (SELECT file FROM ap)
UNION ALL SELECT 'error', c, '', k || coalesce(' ' || r, '') FROM cn"""))
def g04(spark, d):
    p = _pages(spark, d)
    return A.audit(p, p.select("file"), spark.createDataFrame(PAIRS, "pair string, fore string, back string, kind string")).select("severity", "check", "at", "detail")
