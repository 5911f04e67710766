"""DuckDB SQL of the queries that SQL can express, over the exact definitions and without any sketch."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) AS BIGINT) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"

#: Components of vertices v(id) under edges e(a, b), both directions included.
_REACH = "r(id, root) AS (SELECT id, id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)"

NEAR_DEDUP = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct({_SHINGLES}) AS s FROM t), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)), v AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.id = n.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
t AS (SELECT id, kind, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
s AS (SELECT id, kind, list_distinct({_SHINGLES}) AS s FROM t), i AS (SELECT id AS item_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s WHERE kind = 1), x AS (SELECT id AS doc_id, unnest(s) AS g FROM s WHERE kind = 0)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment FROM x JOIN i USING (g) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= 75 * n
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1]), '') AS payload_digest,
CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM f
"""

EMBEDDINGS = f"""
WITH RECURSIVE t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT id, x, sqrt(list_dot_product(x, x)) AS n FROM t WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id AND len(p.x) = len(q.x) AND p.n > 0 AND q.n > 0 WHERE list_dot_product(p.x, q.x) / p.n / q.n >= 0.95),
v AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT c.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c
"""

ORACLE_SQL = {
    "op2_decontamination": DECONTAMINATION,
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op5_warc": WARC,
    "op10_embedding_near_dedup": EMBEDDINGS,
}
