"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

TARGETS = """WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS weight FROM s),
l AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
m AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l)
SELECT source, source_size, weight, round(least(cap::DOUBLE, weight * (SELECT level FROM m WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1)), 3) + 0.0 AS target FROM m"""

OP2 = """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP3 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
f AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM f),
k AS (SELECT doc_id, p, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY doc_id, span),
c AS (SELECT doc_id, -1 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, a, b FROM r),
e AS (SELECT doc_id, b AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS past FROM c),
t AS (SELECT d.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(past, n) - start)), '' ORDER BY start) AS kept FROM d JOIN e USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, (n - strlen(kept) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id)"""

OP5 = """WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a),
least AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""

# crc32 is the sum over the bytes of the decimal number, eight bits each
OP12 = """WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, d, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS place FROM t),
k AS (SELECT DISTINCT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)::BIGINT[]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 6 AS h FROM o),
r AS (SELECT k.c, place, d, chars FROM k JOIN o ON o.c = k.c - k.c % 100 AND place < h UNION ALL SELECT o.c, place, d, chars FROM o JOIN k USING (c) WHERE place >= h),
n AS (SELECT c, d, chars, row_number() OVER (PARTITION BY c ORDER BY place) AS depth FROM r),
p AS (SELECT c, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS chars FROM k
  UNION ALL SELECT p.c, n.depth, path || d, n.chars FROM p JOIN n ON n.c = p.c AND n.depth = p.depth + 1),
m AS (SELECT c, max(depth) AS last FROM p GROUP BY c),
a AS (SELECT path, p.depth, min(chars) AS chars, min(p.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE p.depth = last), '')) AS ends_sha256 FROM p JOIN m USING (c) GROUP BY path, p.depth),
f AS (SELECT a.*, (SELECT count(*) FROM a b WHERE b.depth = a.depth + 1 AND starts_with(b.path, a.path)) AS n_children FROM a),
s AS (SELECT f.path, sum((g.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((g.n_convs - 1) * g.chars)::BIGINT AS saved_tokens FROM f JOIN f g ON starts_with(g.path, f.path) GROUP BY f.path)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f u ON f.depth > 0 AND u.path = substr(f.path, 1, (f.depth - 1) * 32)"""

ORACLES: dict[str, str] = {"op2_one_bit_search": OP2, "op3_suffix_dedup": OP3, "op5_itq_near_duplicates": OP5, "op12_conversation_trie": OP12, "mixing_targets": TARGETS}
