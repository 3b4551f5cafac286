"""DuckDB statements for the text operators' queries that SQL can express."""

from __future__ import annotations

from snarelight.llm.quality import STOP_WORDS

_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rn, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, {_SPACES}, '') <> '') AS ls
  FROM texts
), grams AS (
  SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts WHERE len(ws) >= 3)
), repeated AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rn, count(DISTINCT i + o) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(o) GROUP BY rn
), figures AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {_SPACES}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(translate(t, '!', '')) AS shouts, len(ls) AS n_lines,
    len(list_filter(ws, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS}))) AS stops
  FROM parts LEFT JOIN covered USING (rn)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 4 * n_symbols > n_words OR 2 * shouts > n_words OR 100 * stops < n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM figures
"""

DECONTAMINATE = """
WITH fold AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM items WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT rn, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rn, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM fold, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT rn, i, n, item_id FROM grams JOIN windows USING (n, g)
), words AS (
  SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn
), found AS (
  SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rn, item_id FROM hits) GROUP BY rn
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN words USING (rn) LEFT JOIN found USING (rn)
"""


MIXING = """
WITH RECURSIVE base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(md5(text), '~')) AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), items AS (
  SELECT src, k, CAST(sum(size) AS BIGINT) AS size FROM base GROUP BY src, k
), numbered AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w
  FROM items GROUP BY src
), ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws,
    sum(w) OVER () AS all_w, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM numbered
  WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, cap * (all_w - ws) <= w * (budget - caps) AS full_ FROM ordered
), targets AS (
  SELECT src, source_size, CASE WHEN full_ THEN cap ELSE
    (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / (all_w - coalesce(sum(w) FILTER (full_) OVER (), 0)) * w END AS target
  FROM capped
), state AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets
), turns AS (
  SELECT src, k, size, row_number() OVER (PARTITION BY src ORDER BY k) AS n FROM items
), fill AS (
  SELECT src, CAST(0 AS BIGINT) AS n, target - passes * source_size AS room, CAST(NULL AS VARCHAR) AS took FROM state
  UNION ALL
  SELECT f.src, t.n, CASE WHEN t.size <= f.room THEN f.room - t.size ELSE f.room END,
    CASE WHEN t.size > 0 AND t.size <= f.room THEN t.k END
  FROM fill f JOIN turns t ON t.src = f.src AND t.n = f.n + 1
), left_over AS (
  SELECT src, arg_max(room, n) AS room FROM fill GROUP BY src
), over AS (
  SELECT src, k FROM (
    SELECT t.src, t.k, row_number() OVER (PARTITION BY t.src ORDER BY t.size, t.k) AS place
    FROM turns t JOIN left_over l ON l.src = t.src AND t.size > l.room AND t.size - l.room < l.room
    WHERE NOT EXISTS (SELECT 1 FROM fill f WHERE f.src = t.src AND f.took = t.k)
  ) WHERE place = 1
), picked AS (
  SELECT src, took AS k FROM fill WHERE took IS NOT NULL UNION ALL SELECT src, k FROM over
)
SELECT b.doc_id, b.size, s.source_size, s.target,
  CAST(b.size * (s.passes + CASE WHEN p.k IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken,
  CAST(s.passes + CASE WHEN p.k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies
FROM base b JOIN state s USING (src) LEFT JOIN picked p ON p.src = b.src AND p.k = b.k
"""


NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), units AS (
  SELECT rn, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM usable
), links AS (
  SELECT a.rn AS a, b.rn AS b FROM units a JOIN units b ON a.rn <> b.rn AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a, min(u.vec_id) AS vec_id FROM reach r JOIN units u ON u.rn = r.b GROUP BY 1
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY 1
), whole AS (
  SELECT u.rn, u.vec_id, coalesce(c.n, 0) AS n_links, least(u.vec_id, l.vec_id) AS component_id
  FROM units u LEFT JOIN counts c ON c.a = u.rn LEFT JOIN least l ON l.a = u.rn
  UNION ALL
  SELECT NULL, vec_id, 0, vec_id FROM embeddings WHERE NOT (len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0) OR embedding IS NULL
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM whole
"""


ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op9_quality_rules": QUALITY,
    "op10_mixing": MIXING,
    "op12_embedding_near_dedup": NEAR_VECTORS,
}
