"""DuckDB SQL for the operators that SQL can express."""

def _tree(t: str) -> str:
    return f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,32}}'), lambda x: md5(x))))"


def _join(x: str, sep: str) -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


def _fp(tree: str) -> str:
    para = "md5(" + _join("p", "") + ")"
    sec = f"md5({_join(f'list_transform(s, lambda p: {para})', '')})"
    para_said = f"{para}[1:8] || '+' || " + _join("list_transform(p, lambda x: x[1:8])", ",")
    sec_said = f"{sec}[1:8] || '=' || " + _join(f"list_transform(s, lambda p: {para_said})", ";")
    return f"md5({_join(f'list_transform({tree}, lambda s: {sec})', '')}) || ':' || {_join(f'list_transform({tree}, lambda s: {sec_said})', '/')}"


def _leaves(fp: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(split_part({fp}, ':', 2), '[,;/]'), lambda x: string_split(x, '+')[-1]), lambda x: x <> ''))"


def _apart(a: str, b: str, node: str) -> str:
    """Places from 1 where the nodes of two lists differ."""
    return f"list_filter(range(1, greatest(len({a}), len({b})) + 1), lambda {node}: {a}[{node}][1:8] IS DISTINCT FROM {b}[{node}][1:8])"


def _differing(a: str, b: str) -> str:
    sa, sb = (f"string_split(split_part({x}, ':', 2), '/')" for x in (a, b))
    pa, pb = (f"coalesce(string_split({x}[i][10:], ';'), [])" for x in (sa, sb))
    return f"coalesce(list_sum(list_transform({_apart(sa, sb, 'i')}, lambda i: len({_apart(pa, pb, 'j')}))), 0)"


def _near(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, lead(text) OVER w AS n1, first_value(text) OVER w AS n0 FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, coalesce(n1, n0) AS nxt, length(text) AS n FROM o),
x AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM e),
t AS (SELECT *, {_tree('text')} AS t1, {_tree('edited')} AS t2, {_tree('nxt')} AS t3 FROM x),
f AS (SELECT doc_id, n, edited, {_fp('t1')} AS f1, {_fp('t2')} AS f2, {_fp('t3')} AS f3 FROM t),
l AS (SELECT *, {_leaves('f1')} AS l1, {_leaves('f2')} AS l2, {_leaves('f3')} AS l3 FROM f)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f1 AS fingerprint, f2 AS edited_fingerprint,
       {_near('l1', 'l2')} AS near_edited, {_near('l1', 'l3')} AS near_next, {_differing('f1', 'f2')}::BIGINT AS n_differing
FROM l
"""

# 1000 slots, blocks of 4 documents, parts of 1024 documents, equal weights
OP4 = """
WITH RECURSIVE
c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
i AS (SELECT *, 1000.0::DOUBLE / count(*) OVER () AS ideal FROM c),
b AS (SELECT *, greatest(1, floor(ideal)::INT) AS low FROM i),
b2 AS (SELECT *, 1000 - sum(low) OVER () AS lft, row_number() OVER (ORDER BY ideal - low DESC, source NULLS FIRST) AS rk, row_number() OVER (ORDER BY low DESC, source NULLS FIRST) AS big FROM b),
s AS (SELECT source, n, (low + CASE WHEN rk <= lft THEN 1 ELSE 0 END - CASE WHEN lft < 0 AND big = 1 THEN -lft ELSE 0 END)::INT AS a, (row_number() OVER (ORDER BY source NULLS FIRST))::INT AS i FROM b2),
arr AS (SELECT list(a ORDER BY i) AS a, list(n ORDER BY i) AS n FROM s),
e AS (
  SELECT 0 AS slot, list_transform(a, lambda x: 0) AS c, a, NULL::INT AS pick, NULL::INT[] AS before FROM arr
  UNION ALL
  SELECT slot + 1, list_transform(c, lambda v, j: v + CASE WHEN j = p THEN 1 ELSE 0 END), a, p, c FROM (
    SELECT *, (list_sort(list_filter(list_transform(a, lambda x, j: CASE WHEN floor(c[j] * 1000 / x) <= slot THEN {'d': ceil((c[j] + 1) * 1000 / x), 'j': j} END), lambda x: x IS NOT NULL))[1]).j::INT AS p
    FROM e WHERE slot < 1000)
),
sched AS (SELECT slot - 1 AS slot, pick, before, before[pick] AS occ FROM e WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, (SELECT (count(*) + 1023) // 1024 FROM documents))) AS part FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY part, doc_id NULLS FIRST) - 1 AS rn FROM d),
q AS (SELECT r.*, rn // 4 AS block, s.a AS a, s.i AS i, (rn // 4) // s.a AS per, (rn // 4) % s.a AS o FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, block::BIGINT AS block, (per * 1000 + slot)::BIGINT AS slot, floor(block * 1000 / q.a)::BIGINT AS release, ceil((block + 1) * 1000 / q.a)::BIGINT AS deadline,
  (list_sum(list_transform(arr.n, lambda m, j: least(m, 4 * (sched.before[j] + per * arr.a[j])))) + rn % 4)::BIGINT AS position
FROM q JOIN sched ON sched.pick = q.i AND sched.occ = q.o CROSS JOIN arr
"""


def _spans(pattern: str, kind: str, order: int, group: int) -> str:
    """One row a match: the pieces between the matches give the offsets."""
    return f"""
SELECT rid, '{kind}' AS kind, {order} AS ord, v AS value,
  (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS s0, length(hit) AS n
FROM (SELECT rid, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS v
      FROM (SELECT rid, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d WHERE regexp_matches(t, '{pattern}')))
WINDOW w AS (PARTITION BY rid ORDER BY i)"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SAID = "coalesce(string_agg(kind || ':' || s0 || ':' || (s0 + n), ',' ORDER BY s0, ord), '')"
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({_spans(_ASSIGN, 'assign', 0, 2)}) WHERE length(value) >= 12
  UNION ALL {_spans('AKIA[A-Z0-9]{14,}', 'access', 1, 0)}
  UNION ALL {_spans('[0-9a-f]{16,}', 'hex', 2, 0)}),
opaque AS (SELECT * FROM ({_spans('[A-Za-z0-9+/_=-]{24,}', 'opaque', 3, 0)}) o
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s0 < o.s0 + o.n AND o.s0 < b.s0 + b.n)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
held AS (SELECT value, count(DISTINCT coalesce('=' || source, '-')) AS owners, count(DISTINCT coalesce('=' || source, '-') || '/' || coalesce(doc_id::VARCHAR, '-')) AS repos FROM cand JOIN d USING (rid) GROUP BY value),
judged AS (SELECT cand.*, owners <= 2 AND repos <= 20 AS live, repos FROM cand JOIN held USING (value) WHERE ord < 3 OR (owners <= 2 AND repos <= 20)),
b AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_SAID} AS said FROM base GROUP BY rid),
f AS (SELECT rid, {_SAID} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(repos) AS repos FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(repos, 0)::BIGINT AS n_repositories
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


def _crc(x: str) -> str:
    """The CRC-32 of a number's decimal digits."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _manifest(depth: int = 20, top_depth: int = 20) -> str:
    """Levels of 3 up to 3^20 leaves; a level of one node stays as it is."""
    piece = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(piece(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS s, lang, n_chars, text,
  CASE WHEN {_crc('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
f AS MATERIALIZED (SELECT rid, doc_id, source, s, {leaf("text")} AS leaf, {leaf("other")} AS changed FROM d),
p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, changed AS back FROM f),
n0 AS MATERIALIZED (SELECT s, i, leaf AS d, count(*) OVER (PARTITION BY s) AS w FROM p0)"""

    def level(a: int, b: int) -> str:
        whole = "array_to_string(ds[1:(i % 3)::BIGINT], '')", "array_to_string(ds[(i % 3 + 2)::BIGINT:], '')"
        return f""",
r{a} AS MATERIALIZED (SELECT s, i // 3 AS g, list(d ORDER BY i) AS ds, max(w) AS w FROM n{a} GROUP BY s, i // 3),
n{b} AS MATERIALIZED (SELECT s, g AS i, CASE WHEN w = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (w + 2) // 3 AS w FROM r{a}),
p{b} AS MATERIALIZED (SELECT p.* REPLACE (i // 3 AS i, CASE WHEN w = 1 THEN proof ELSE proof || {whole[0]} || {whole[1]} END AS proof,
  CASE WHEN w = 1 THEN back ELSE sha256({whole[0]} || back || {whole[1]}) END AS back) FROM p{a} p JOIN r{a} r ON p.s = r.s AND p.i // 3 = r.g)"""

    for k in range(depth):
        out += level(k, k + 1)
    k = depth + 1
    out += f""",
u AS MATERIALIZED (SELECT s, d AS subroot, row_number() OVER (ORDER BY s) - 1 AS rank FROM n{depth}),
n{k} AS MATERIALIZED (SELECT '' AS s, rank AS i, subroot AS d, count(*) OVER () AS w FROM u),
p{k} AS MATERIALIZED (SELECT rid, doc_id, source, '' AS s, leaf, subroot, rank AS i, proof, back FROM p{depth} p JOIN u USING (s))"""
    for k in range(depth + 1, depth + top_depth + 1):
        out += level(k, k + 1)
    k = depth + top_depth + 1
    return out + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, back AS folded_root, back = d AS verified FROM p{k} CROSS JOIN n{k}
"""


OP11 = _manifest()

OP13 = f"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM t),
l AS (SELECT c, count(*) AS m, {_crc('c')} % 6 AS h, c - c % 100 AS b FROM t GROUP BY c),
cs AS MATERIALIZED (SELECT l.c, l.h, l.b, least(l.h, coalesce(x.m, 0)) AS kept FROM l LEFT JOIN l x ON x.c = l.b),
r AS (SELECT cs.c, o.pos, k, n FROM cs JOIN o ON o.c = cs.b WHERE o.pos <= cs.h UNION ALL SELECT cs.c, o.pos - h + kept, k, n FROM cs JOIN o ON o.c = cs.c WHERE o.pos > h),
p AS MATERIALIZED (SELECT c, pos AS depth, n, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos) AS prefix, pos = count(*) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT c, 0, 0, '', NOT EXISTS (SELECT 1 FROM r WHERE r.c = cs.c) FROM cs),
g AS MATERIALIZED (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, prefix),
x AS MATERIALIZED (SELECT g.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM g y WHERE y.depth > 0 AND y.prefix[1:length(y.prefix) - 32] = g.prefix) AS n_children FROM g LEFT JOIN g q ON g.depth = q.depth + 1 AND g.prefix[1:length(g.prefix) - 32] = q.prefix),
s AS (SELECT prefix[1:32 * unnest(range(0, depth + 1))] AS prefix, own, n_children = 0 AS leaf FROM x),
z AS (SELECT prefix, count(*) FILTER (leaf) AS n_leaves, sum(own) AS saved FROM s GROUP BY prefix)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM x JOIN z USING (prefix)
"""

SQL = {"op1_document_fingerprints": OP1, "op4_source_mixing": OP4, "op9_secret_scan": OP9, "op11_dataset_manifest": OP11, "op13_conversation_trie": OP13}
