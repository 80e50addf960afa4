"""DuckDB SQL of operators 11 to 13."""

#: The crc32 of a text, from its bytes in hexadecimal digits, bit by bit: DuckDB has no such function.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len({x}), 2), lambda i: [CAST('0x' || substr({x}, i, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                            lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, true AS own
  FROM documents
  UNION ALL
  SELECT NULL, NULL, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false
  FROM benchmark),
g AS (
  SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS f
  FROM d),
c AS (SELECT f, own, r, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT f, hex(encode(f)) AS x FROM c GROUP BY f),
b AS (
  SELECT f, {_CRC.format(x='x')} % 10000 AS bucket FROM k),
s AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM c JOIN b USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s),
w AS (SELECT r, sum(n * gain) AS weight, sum(n) AS n_features FROM c JOIN b USING (f) JOIN gain USING (bucket) WHERE own GROUP BY r),
o AS (
  SELECT doc_id, r, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) >= 20 AS fit,
         (CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM d LEFT JOIN w USING (r) WHERE own),
e AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM o),
p AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id) AS place, 5 * count(*) FILTER (fit) OVER () // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM p"""

#: Texts with the same set are one class; links between classes, then the closure of what links reach.
NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM d),
c AS (SELECT md5(array_to_string(s, '|')) AS k, any_value(s) AS s, any_value(len(s)) AS n, min(doc_id) AS sid FROM s WHERE len(s) > 0 GROUP BY 1),
u AS (SELECT sid, n, unnest(s) AS g FROM c),
l AS (
  SELECT a.sid AS a, b.sid AS b FROM u a JOIN u b ON a.g = b.g AND a.sid <> b.sid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT sid, sid AS root FROM c UNION SELECT r.sid, l.b FROM r JOIN l ON r.root = l.a),
m AS (SELECT sid, min(root) AS component_id FROM r GROUP BY sid)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND md5(array_to_string(s.s, '|')) = c.k LEFT JOIN m ON c.sid = m.sid"""

#: A node is known by its turns as JSON.
TRIE = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT c, hex(encode(CAST(c AS VARCHAR))) AS x FROM t),
k AS (SELECT c, c - c % 5 AS base, {_CRC.format(x='x')} % 9 AS h FROM i),
r AS (
  SELECT k.c, 0 AS part, pos, role, text FROM k JOIN t ON t.c = k.base AND pos <= h
  UNION ALL
  SELECT k.c, 1, pos, role, text FROM k JOIN t ON t.c = k.c AND pos > h),
q AS (SELECT k.c, coalesce(list([role, text] ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS turns FROM k LEFT JOIN r USING (c) GROUP BY k.c),
p AS (SELECT c, d, turns[d][2] AS last, len(turns) = d AS ended, md5(CAST(to_json(turns[1:d]) AS VARCHAR)) AS key FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM q)),
g AS (SELECT a.*, b.key AS up FROM p a LEFT JOIN p b ON a.c = b.c AND a.d = b.d + 1),
n AS (
  SELECT key, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(any_value(last))), 0) AS size,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '') AS ends
  FROM g GROUP BY key, d),
c AS (SELECT up AS key, count(*) AS n_children FROM n GROUP BY up),
v AS (
  SELECT p.key, count(*) FILTER (c.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM n LEFT JOIN c USING (key) JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.key)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, v.n_leaves,
       CAST(v.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN n o ON n.up = o.key LEFT JOIN c ON c.key = n.key JOIN v ON v.key = n.key"""
