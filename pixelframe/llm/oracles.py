"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACED = "translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
_BLANK = "trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = ''"

URLS = """
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (
  SELECT page_id, row_number() OVER () AS k,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
m AS (
  SELECT k, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""

CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(role, '\\|<<TURN>>|\[/?INST\]|</?s>', '_\0', 'g'))
    + length(regexp_replace(text, '\\|<<TURN>>|\[/?INST\]|</?s>', '_\0', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN role = 'assistant' THEN 15 ELSE 25 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
    list_filter(string_split({_SPACED}, ' '), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM n, (VALUES (0), (1), (2)) AS v(o) GROUP BY k),
l AS (
  SELECT k, count(*) AS n, count(*) FILTER (NOT {_BLANK}) - count(DISTINCT x) FILTER (NOT {_BLANK}) AS dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d) GROUP BY k),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, l.dup::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, l.n AS lines,
    length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS capitals
  FROM d JOIN l USING (k) LEFT JOIN p USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * capitals > word_chars OR 2 * n_dup_lines > lines
    OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words) AS kept
FROM b
"""

NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(translate({_SPACED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.both >= 75 * (x.n + y.n - p.both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k, a.vec_id AS anchor_id, b.k AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.k <> b.k),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id, other) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.k, p.other ORDER BY n.score DESC, n.id, n.other)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.k = n.k AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

MANIFEST = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, text, doc_id::VARCHAR AS id,
    list_reduce([4294967295] || flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ord((doc_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, v: CASE WHEN v < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, v) END) & 1 AS crc
  FROM documents),
h AS (
  SELECT k, doc_id, source, crc = 1 AS tampered, [coalesce(strlen(id) || ':' || id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')] AS f,
    text, replace(text, chr(10), '') AS cut FROM d),
l AS (
  SELECT k, doc_id, source, sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(array_to_string(f, '') || coalesce(strlen(cut) || ':' || cut, '-')) END AS altered FROM h),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t(level, source, pos, n, digest) AS (
  SELECT 0, source, pos, n, leaf FROM p
  UNION ALL
  SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, source, pos // 3, n),
s AS (
  SELECT source, level AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
f(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM s
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM f WHERE n > 1 GROUP BY level, pos // 3, n),
w AS (
  SELECT p.k, t.level AS step, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos < t.pos), '') AS a,
    coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos > t.pos), '') AS b
  FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.pos = p.pos // (3 ** t.level)::BIGINT AND t.n > 1
    JOIN t o ON o.source IS NOT DISTINCT FROM t.source AND o.level = t.level AND o.pos // 3 = t.pos // 3
  GROUP BY p.k, t.level, t.pos
  UNION ALL
  SELECT p.k, s.height + f.level, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos < f.pos), ''),
    coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos > f.pos), '')
  FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN f ON f.pos = s.pos // (3 ** f.level)::BIGINT AND f.n > 1
    JOIN f o ON o.level = f.level AND o.pos // 3 = f.pos // 3
  GROUP BY p.k, s.height, f.level, f.pos),
r(k, step, digest) AS (
  SELECT k, 0, coalesce(altered, leaf) FROM p
  UNION ALL
  SELECT r.k, r.step + 1, sha256(a || digest || b) FROM r JOIN w ON w.k = r.k AND w.step = r.step),
e AS (SELECT k, max_by(digest, step) AS top FROM r GROUP BY k),
q AS (SELECT k, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM w GROUP BY k)
SELECT p.doc_id, p.leaf, s.digest AS subroot, g.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.top AS folded_root, e.top = g.digest AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN e USING (k) LEFT JOIN q USING (k), (SELECT digest FROM f WHERE n = 1) g
"""
