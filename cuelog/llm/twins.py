"""SQL with the same results as the queries that SQL can state."""

from __future__ import annotations

from .secrets import RULES

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Matches and the gaps between them, added up to places, rule by rule."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = _quoted(("(?i)" if rule.any_case else "") + rule.pattern)
        parts.append(f"""SELECT rid, {rank} AS r, '{rule.kind}' AS k, unnest(list_transform(range(1, len(l) + 1), lambda i: {{
            'b': list_sum(g[1:i])::BIGINT + coalesce(list_sum(l[1:i - 1]), 0)::BIGINT, 'n': l[i], 'h': h[i] >= {rule.least}}})) AS x FROM (
            SELECT rid, list_transform(string_split_regex(t, {pattern}), lambda v: length(v)) AS g, list_transform(regexp_extract_all(t, {pattern}, 0), lambda v: length(v)) AS l,
                list_transform(regexp_extract_all(t, {pattern}, {rule.group}), lambda v: length(v)) AS h FROM d WHERE regexp_matches(t, {pattern}))""")
    spelled = "string_agg(k || ':' || b || ':' || e, ',' ORDER BY b, r)"
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (k = '{kind}') AS n_{kind}" for kind in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
f AS (SELECT rid, r, k, x.b AS b, x.b + x.n AS e FROM s WHERE x.h)
SELECT doc_id, {counts}, sha256(coalesce({spelled} FILTER (r < {len(base)}), '')) AS base_sha256, coalesce({spelled}, '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


PASSAGES = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS i,
             unnest(list_transform(range(1, len(ws) - 11), lambda i: md5_number(array_to_string(ws[i:i + 12], ' ')))) AS h FROM w WHERE len(ws) >= 13),
m AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS k FROM p JOIN m USING (h) WHERE first < doc_id),
a AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
j AS (SELECT a.rid, count(*) FILTER (c.k IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY a.k) FILTER (c.k IS NULL) AS kept
      FROM a LEFT JOIN c ON c.rid = a.rid AND c.k = a.k GROUP BY a.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN j USING (rid)"""

_LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_LOWERED} AS ws FROM benchmark),
v AS (SELECT item, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: md5_number(array_to_string(ws[i:i + 9], ' ')))) AS h FROM b WHERE len(ws) > 0),
z AS (SELECT DISTINCT n FROM v),
p AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i,
             unnest(list_transform(range(1, len(ws) - n + 2), lambda i: md5_number(array_to_string(ws[i:i + n - 1], ' ')))) AS h FROM w JOIN z ON len(ws) >= n),
o AS (SELECT DISTINCT rid, i, n, item FROM p JOIN v USING (n, h)),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit; 3988292384 is the reversed polynomial."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def manifest_sql() -> str:
    """Levels of both kinds of trees by recursion, then every leaf's way up through them."""
    climb = """SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {t} WHERE n > 1 GROUP BY tree, level, pos // 3"""
    step = """SELECT f.rid, f.tree, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.node ELSE t.digest END, '' ORDER BY t.pos)),
              f.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
              FROM {f} f JOIN {t} t ON t.tree = f.tree AND t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE t.n > 1 GROUP BY f.rid, f.tree, f.level, f.pos, f.proof"""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS leaf,
           CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, leaf, n FROM p UNION ALL {climb.format(t='t')}),
s AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(tree, level, pos, digest, n) AS (SELECT '', 0, pos, subroot, n FROM s UNION ALL {climb.format(t='u')}),
f(rid, tree, level, pos, node, proof) AS (SELECT rid, tree, 0, pos, coalesce(tampered, leaf), '' FROM p UNION ALL {step.format(f='f', t='t')}),
g AS (SELECT rid, max_by(tree, level) AS tree, max_by(node, level) AS node, max_by(proof, level) AS proof FROM f GROUP BY rid),
h(rid, tree, level, pos, node, proof) AS (SELECT g.rid, '', 0, s.pos, g.node, g.proof FROM g JOIN s ON s.name = g.tree UNION ALL {step.format(f='h', t='u')}),
e AS (SELECT rid, max_by(node, level) AS folded_root, max_by(proof, level) AS proof FROM h GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM u WHERE n = 1) AS verified
FROM d JOIN s ON s.name = d.tree JOIN e USING (rid)"""


def groups_sql(words: int, percent: int) -> str:
    """All pairs with a common run of words, and what they reach."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({lowered}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - {words - 2}, 2) END), lambda i: md5_number(array_to_string(ws[i:i + {words - 1}], ' ')))) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id"""


def repair_sql() -> str:
    """A conversation's rows one after the other: for each of four states the cheapest, then least edits so far."""
    user, reply = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    ways = ", ".join(f"({s}, {n}, {via}, {text})" for s, n, via, text in [
        (0, 0, 0, "''"), (0, 1, 2, user), (0, 2, 3, f"{user} || {reply}"), (1, 0, 1, "''"), (1, 1, 2, user), (1, 2, 3, f"{user} || {reply}"),
        (2, 0, 2, "''"), (2, 1, 3, reply), (2, 2, 2, f"{reply} || {user}"), (3, 0, 3, "''"), (3, 1, 2, user), (3, 2, 3, f"{user} || {reply}")])
    edits = ", ".join([f"({s}, 'D', NULL, {s}, 4, NULL)" for s in range(4)] + [f"({s}, 'R', NULL, {t}, 3, '{r}')" for s, t, r in [(0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user")]]
                      + [f"({s}, 'K', '{i}', {t}, 0, NULL)" for s, i, t in [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]])
    checksum = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, coalesce(':' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {checksum} % 20 AS k FROM conversations),
d AS (SELECT key, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE k <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM d),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(role[1]) OVER (PARTITION BY key ORDER BY p) || role[1] AS pair FROM (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY p) AS seen FROM q)),
w(s, n, via, made) AS (VALUES {ways}), e(via, letter, initial, state, price, name) AS (VALUES {edits}),
v(key, p, s, b) AS (SELECT DISTINCT key, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': '', 't': ''}} FROM f
    UNION ALL SELECT v.key, v.p + 1, e.state, min({{'c': v.b.c + 3 * w.n + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'a': v.b.a || repeat('I', w.n) || e.letter,
        't': v.b.t || w.made || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || e.name || ':' || f.text END}})
    FROM v JOIN f ON f.key = v.key AND f.p = v.p + 1 JOIN w ON w.s = v.s JOIN e ON e.via = w.via AND (e.initial IS NULL OR e.initial = f.role[1])
    WHERE e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate') GROUP BY v.key, v.p, e.state),
g AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key),
t AS (SELECT v.key, min({{'c': v.b.c + CASE v.s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': v.b.a || CASE v.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
        't': v.b.t || CASE v.s WHEN 1 THEN {user} || {reply} WHEN 2 THEN {reply} ELSE '' END}}) AS b FROM v JOIN g ON g.key = v.key AND g.n = v.p GROUP BY v.key)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(t.b.c, 0) AS cost, coalesce(t.b.a, '') AS audit, sha256(coalesce(t.b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM o) i LEFT JOIN g USING (key) LEFT JOIN t USING (key)"""
