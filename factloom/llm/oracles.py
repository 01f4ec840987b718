"""SQL for the operators whose rows SQL can state: repeated strings, the Jaccard join, the trie and the audit.

The others rest on what SQL here doesn't have (vocabularies, keyed hashes of another engine,
fitted models) and are compared with brute force in the tests.
"""

from __future__ import annotations

# Bytes are pairs of hex digits, so that positions are bytes and substrings stay cheap.
OP7_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
l AS (SELECT unnest([192, 400]) AS size),
w AS (SELECT doc_id, size, i, hash(size, substring(h, 2 * i + 1, 2 * size)) AS k FROM (SELECT *, unnest(range(0, n - size + 1)) AS i FROM d, l WHERE n >= size)),
m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, size, i, CASE WHEN i > lag(i) OVER q + size THEN 1 ELSE 0 END AS fresh FROM w WHERE k IN (SELECT k FROM m) WINDOW q AS (PARTITION BY doc_id, size ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, size ORDER BY i) AS run FROM s),
r AS MATERIALIZED (SELECT doc_id, size, min(i) AS a, max(i) + size AS b FROM g GROUP BY doc_id, size, run),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER q AS last, lead(a) OVER q AS next FROM r WHERE size = 400 WINDOW q AS (PARTITION BY doc_id ORDER BY a)),
c AS (SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
  string_agg(substring(h, 2 * last + 1, 2 * (a - last)) || CASE WHEN next IS NULL THEN substring(h, 2 * b + 1, 2 * (n - b)) ELSE '' END, '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id),
y AS (SELECT doc_id, i, substring(h, 2 * i + 1, 2) IN ('20', '09', '0A', '0B', '0C', '0D') AS space FROM (SELECT *, unnest(range(0, n)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM r))),
x AS (SELECT doc_id, i FROM (SELECT *, lag(space, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS edge FROM y) WHERE edge AND NOT space),
p AS (SELECT r.doc_id, r.a, count(*) AS words FROM r JOIN x ON x.doc_id = r.doc_id AND x.i >= r.a AND x.i < r.b WHERE size = 192 GROUP BY ALL HAVING count(*) > 50),
z AS (SELECT doc_id, sum(words)::BIGINT AS passage_words FROM p GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(passage_words, 0) AS passage_words
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)"""

OP8_JACCARD = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(1))) WHEN len(w) > 0 THEN [array_to_string(w, chr(1)) || chr(2)] ELSE [] END) AS g FROM t),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM k),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS root FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, t.doc_id) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.node = t.doc_id"""


def crc32(s: str) -> str:
    """The unsigned CRC-32 of an ASCII string expression, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i::INT, 1))::UBIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""


OP11_CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS key, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM t),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc32('conv_id::VARCHAR')} % 6 AS h FROM t),
s AS (SELECT i.conv_id, o.pos AS place, key, size FROM i JOIN o ON o.conv_id = base AND pos <= h UNION ALL SELECT conv_id, 1000000000 + pos, key, size FROM o JOIN i USING (conv_id) WHERE pos > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, size, string_agg(key, ',') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
p AS MATERIALIZED (SELECT conv_id, depth, size, md5(path) AS node, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM d UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM s) FROM i),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, min(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node, depth),
u AS (SELECT n.node, n.depth, q.node AS parent, q.conv_id AS parent_conv_id FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n q ON q.node = p.node AND q.depth = p.depth),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
a AS (SELECT p.node, p.depth, sum((n.n - 1) * n.size)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k ON k.node = n.node AND k.depth = n.depth GROUP BY p.node, p.depth)
SELECT conv_id, n.depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN a USING (node, depth) LEFT JOIN u USING (node, depth) LEFT JOIN k USING (node, depth)"""

OP12_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM t GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
k AS MATERIALIZED (SELECT lang, source, term, c.n FROM c SEMI JOIN l USING (lang, term)),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(v.v), 0) AS v, coalesce((SELECT sum(n) FROM k WHERE k.lang = d.lang AND k.source = d.source), 0)::HUGEINT AS total FROM d LEFT JOIN v ON v.lang = d.lang GROUP BY d.lang, d.source),
x AS MATERIALIZED (SELECT g.lang, g.source, l.term, 1 + 1000000000::HUGEINT * (coalesce(k.n, 0) + 1) // (g.total + g.v) AS p, coalesce(k.n, 0) AS n FROM g JOIN l ON l.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term),
w AS (SELECT l.lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q FROM l JOIN v ON v.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
m AS (SELECT x.lang, source, 'term' AS part, x.term AS item, (p - q) * (p - q) // q AS value FROM x JOIN w ON w.lang = x.lang AND w.term = x.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM m))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200"""
