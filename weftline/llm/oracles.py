"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce({LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM cut
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT s.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(s.host || s.path, '^(ads?|adserver|banners?|track(er|ing)?)[0-9]*\\.')
    OR regexp_matches(s.host || s.path, '(^|[.-])(casino|betting|porn|xxx)[0-9]*[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
"""

_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
test AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)
),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM test) s, unnest(range(1, len(w) - n + 2)) AS t(i)
),
hits AS (SELECT r, runs.n, i, item FROM runs JOIN test ON runs.win = test.win AND runs.n = test.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

_PLAIN = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
names AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM names LEFT JOIN sizes USING (doc_id)
"""

def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    start = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({start}, lambda c, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP11 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, doc_id, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(LOWER.format("text"))} ELSE {_leaf("text")} END AS seen
  FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up(s, k, pos, h, n) AS (
  SELECT s, 0, pos, leaf, count(*) OVER (PARTITION BY s) FROM leaves
  UNION ALL
  SELECT s, k + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY s, k, pos // 16, n
),
subroots AS (SELECT s, h, k AS height FROM up WHERE n = 1),
top(k, pos, h, n) AS (
  SELECT 0, s, h, count(*) OVER () FROM subroots
  UNION ALL
  SELECT k + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY k, pos // 16, n
),
beside AS (
  SELECT l.r, u.k, u.pos, u.h, u.pos - l.pos // CAST(16 ** u.k AS BIGINT) AS side
  FROM leaves l JOIN up u ON u.s = l.s AND u.n > 1 AND u.pos // 16 = l.pos // CAST(16 ** u.k AS BIGINT) // 16
  UNION ALL
  SELECT l.r, b.height + t.k, t.pos, t.h, t.pos - l.s // CAST(16 ** t.k AS BIGINT)
  FROM leaves l JOIN subroots b ON b.s = l.s JOIN top t ON t.n > 1 AND t.pos // 16 = l.s // CAST(16 ** t.k AS BIGINT) // 16
),
flanks AS (
  SELECT r, k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (side < 0), '') AS lo, coalesce(string_agg(h, '' ORDER BY pos) FILTER (side > 0), '') AS hi
  FROM beside GROUP BY r, k
),
folded(r, k, h) AS (
  SELECT r, 0, seen FROM leaves
  UNION ALL
  SELECT f.r, f.k + 1, sha256(x.lo || f.h || x.hi) FROM folded f JOIN flanks x ON x.r = f.r AND x.k = f.k
),
ends AS (SELECT r, max_by(h, k) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof FROM flanks GROUP BY r),
summit AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, b.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots b USING (s) JOIN ends USING (r) LEFT JOIN proofs USING (r) CROSS JOIN summit
"""

OP12 = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
plans AS (
  SELECT s.c, s.c - s.c % 100 AS base, s.n, {_crc32("CAST(s.c AS VARCHAR)")} % 6 AS h, coalesce(b.n, 0) AS has
  FROM sizes s LEFT JOIN sizes b ON b.c = s.c - s.c % 100
),
seqs AS (
  SELECT c, 0 AS d, '' AS t, 0 AS chars FROM plans
  UNION ALL SELECT p.c, o.i, o.t, o.chars FROM plans p JOIN own o ON o.c = p.base AND o.i <= p.h
  UNION ALL SELECT p.c, o.i - p.h + least(p.h, p.has), o.t, o.chars FROM plans p JOIN own o ON o.c = p.c AND o.i > p.h
),
paths AS (
  SELECT c, d, chars, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS path, d = max(d) OVER (PARTITION BY c) AS last FROM seqs
),
nodes AS (
  SELECT path, d, max(chars) AS chars, count(*) AS n, min(c) AS least, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends
  FROM paths GROUP BY path, d
),
tree AS (
  SELECT v.*, p.least AS parent, (SELECT count(*) FROM nodes x WHERE x.d = v.d + 1 AND substr(x.path, 1, 64 * v.d) = v.path) AS children
  FROM nodes v LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = substr(v.path, 1, 64 * (v.d - 1))
),
above AS (
  SELECT substr(path, 1, 64 * k) AS path, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * chars) AS saved
  FROM tree, unnest(range(0, d + 1)) AS u(k) GROUP BY 1
)
SELECT least AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM tree JOIN above USING (path)
"""

ORACLES = {"op3_url_filter": OP3, "op5_decontamination": OP5, "op8_minhash": OP8, "op11_merkle_manifest": OP11, "op12_prefix_trie": OP12}
