"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS digest FROM p),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS low FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN low IS DISTINCT FROM page_id AND low IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low IS DISTINCT FROM page_id THEN low END AS refers_to
FROM g
"""

# kind, pattern (letters in either case spelled out), group, least length; the base rules as they are stated
_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
]


def _kind(n: int, kind: str, pattern: str, group: int, least: int) -> str:
    rx = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT r, {n} AS k, '{kind}' AS kind, pos AS s, pos + length(hit) AS e FROM (
  SELECT r, m[i] AS hit, q[i] AS part,
         gaps[i] + CASE WHEN i > 1 THEN list_sum(list_transform(m[1:i - 1], lambda x: length(x))) + list_sum(gaps[1:i - 1]) ELSE 0 END AS pos
  FROM (SELECT r, m, q, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, {rx}) AS m, regexp_extract_all(t, {rx}, {group}) AS q,
           list_transform(string_split_regex(t, {rx}), lambda x: length(x)) AS gaps
    FROM d WHERE regexp_matches(t, {rx})))
  WHERE length(q[i]) >= {least})
"""


# runs of hex digits are many: the bounded form has the same matches of the least length
_BOUNDED = [(k, p.replace("[0-9a-f]+", "[0-9a-f]{16,}"), g, n) for k, p, g, n in _RULES]
_ALL = " UNION ALL ".join(_kind(n, *r) for n, r in enumerate(_BOUNDED))
SQL["op4_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_ALL}),
by_row AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (r)
"""

SQL["op12_infill"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# crc32 of a decimal, bit by bit: the reflected polynomial
_CRC = "list_reduce(list_transform(string_split(CAST(k AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), " \
       "lambda crc, c: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(crc, c)), 4294967295)"
SQL["op11_prefixes"] = f"""
WITH t AS (
  SELECT conv_id AS k, coalesce(text, '') AS text, CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS body, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT k, text, sha256(body) AS d, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(body)) AS place FROM t),
ids AS (SELECT k, k - k % 100 AS base, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT k FROM t)),
mixed AS (
  SELECT ids.k, 0 AS own, o.place, o.d, o.text FROM ids JOIN o ON o.k = ids.base AND o.place <= ids.h
  UNION ALL SELECT o.k, 1, o.place, o.d, o.text FROM o JOIN ids USING (k) WHERE o.place > ids.h),
turns AS (SELECT k, text, d, row_number() OVER (PARTITION BY k ORDER BY own, place) AS depth FROM mixed),
paths AS (
  SELECT k, 0 AS depth, '' AS path, 0 AS chars FROM ids
  UNION ALL SELECT k, depth, string_agg(d, '/') OVER (PARTITION BY k ORDER BY depth), length(text) FROM turns),
lasts AS (SELECT k, max(depth) AS depth FROM paths GROUP BY k),
nodes AS (
  SELECT path, depth, min(k) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE (k, depth) IN (SELECT (k, depth) FROM lasts)), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
up AS (
  SELECT n.path, n.depth, q.conv_id AS parent_conv_id FROM nodes n JOIN paths p ON p.k = n.conv_id AND p.depth = n.depth - 1
  JOIN nodes q ON q.path = p.path AND q.depth = p.depth),
kids AS (SELECT p.path, p.depth, count(*) AS n_children FROM nodes n JOIN paths p ON p.k = n.conv_id AND p.depth = n.depth - 1 GROUP BY ALL),
totals AS (
  SELECT p.path, p.depth, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n LEFT JOIN kids ON kids.path = n.path AND kids.depth = n.depth
  JOIN paths p ON p.k = n.conv_id AND p.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, totals.n_leaves,
       CAST(totals.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals ON totals.path = n.path AND totals.depth = n.depth
LEFT JOIN kids ON kids.path = n.path AND kids.depth = n.depth LEFT JOIN up ON up.path = n.path AND up.depth = n.depth
"""
