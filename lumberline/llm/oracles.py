"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

# Base32 of the 160 bits of the digest: 32 letters of five bits.
SEEKABLE_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, html, array_to_string(list_transform(range(40), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
    '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', h[i + 1])]), '') AS bits FROM p
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
    + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS payload_digest FROM b
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM m
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

PREFERENCE_PAIRS = """
WITH said AS (
  SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, role, text FROM conversations
), ends AS (
  SELECT pair_id, max(turn) AS last FROM said WHERE role = 'assistant' GROUP BY pair_id
), earlier AS (
  SELECT s.pair_id, arg_max(coalesce(s.text, ''), s.turn) AS old FROM said s JOIN ends e ON s.pair_id = e.pair_id
  WHERE s.role = 'assistant' AND s.turn < e.last GROUP BY s.pair_id
), sides AS (
  SELECT s.pair_id, s.turn, s.role, s.text AS c_text,
    CASE WHEN s.turn = e.last AND s.role = 'assistant' THEN coalesce(o.old, '') ELSE s.text END AS r_text
  FROM said s JOIN ends e ON s.pair_id = e.pair_id LEFT JOIN earlier o ON s.pair_id = o.pair_id WHERE s.turn <= e.last
), split AS (
  SELECT pair_id, min(turn) FILTER (c_text IS DISTINCT FROM r_text) AS split FROM sides GROUP BY pair_id
), r AS (
  SELECT s.pair_id, s.turn, s.turn // 64 AS part, s.role, p.split IS NULL OR s.turn < p.split AS common,
    '<|' || coalesce(s.role, '') || '|>' || chr(10) AS head,
    coalesce(c_text, '') || '<|end|>' || chr(10) AS c_body, coalesce(r_text, '') || '<|end|>' || chr(10) AS r_body
  FROM sides s JOIN split p ON s.pair_id = p.pair_id
), o AS (
  SELECT *,
    coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(c_body) END) OVER w, 0) AS c_at,
    coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(r_body) END) OVER w, 0) AS r_at
  FROM r WINDOW w AS (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT pair_id, part, count(*) FILTER (common) AS prompt_turns,
  coalesce(string_agg(head || c_body, '' ORDER BY turn) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || c_body, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg((c_at + length(head))::BIGINT || '+' || length(c_body), ',' ORDER BY turn)
    FILTER (NOT common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || r_body, '' ORDER BY turn) FILTER (NOT common), '') AS rejected,
  coalesce(string_agg((r_at + length(head))::BIGINT || '+' || length(r_body), ',' ORDER BY turn)
    FILTER (NOT common AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id, part
"""

# Terms, shares and distances in whole numbers; a source's term that it lacks has a count of 0.
SOURCE_AUDIT = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM d)
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source)
), l AS (
  SELECT lang, sum(lang_n) AS n, count(*) AS v FROM k GROUP BY lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS own, k.lang_n, l.n AS lang_total, l.v,
    CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (k.lang_n + 1) // (l.n + l.v) AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), y AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), z AS (
  SELECT lang, source, 'pair' AS part, item, value FROM y
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE own > 0 AND p > q
)
SELECT lang, source, part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM z QUALIFY part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": EXACT_DEDUP,
    "op5_seekable_warc": SEEKABLE_WARC,
    "op9_exact_top_k": EXACT_TOP_K,
    "op10_preference_pairs": PREFERENCE_PAIRS,
    "op13_source_audit": SOURCE_AUDIT,
}
