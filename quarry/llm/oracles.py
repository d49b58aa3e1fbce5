"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq FROM t
), n AS (
  SELECT *, len(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) + 4 AS tokens, length(body) + length(role) + 23 AS chars FROM e
), s AS (
  SELECT *, coalesce(max(CASE WHEN seq = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys,
         coalesce(max(CASE WHEN seq = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS syschars,
         sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq) - tokens AS start FROM n
), p AS (
  SELECT *, greatest(1792 - sys, 896) AS stride, (seq = 0 AND role = 'system') AS is_system, CASE WHEN seq = 0 THEN 0 ELSE start - sys END AS first FROM s
), w AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE 2 * (first // stride) + CASE WHEN (first + tokens - 1) // stride > first // stride THEN 1 ELSE 0 END END AS win FROM p
), spans AS (
  SELECT conv_id, win, min(CASE WHEN NOT is_system THEN first END) AS begins, min(stride) AS stride, max(syschars) AS syschars, bool_or(is_system) AS has_system FROM w GROUP BY conv_id, win
), again AS (
  SELECT spans.conv_id, sum(w.chars) AS chars FROM spans JOIN w ON spans.conv_id = w.conv_id AND NOT w.is_system AND w.first + w.tokens <= begins AND begins - w.first <= least(256, spans.stride) GROUP BY spans.conv_id
), kept AS (
  SELECT conv_id, sum(CASE WHEN has_system THEN 0 ELSE syschars END) AS chars FROM spans GROUP BY conv_id
), own AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq) AS said,
         coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS loss FROM w GROUP BY conv_id
)
SELECT own.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(own.chars + kept.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM own JOIN kept USING (conv_id) LEFT JOIN again USING (conv_id)
"""

ORACLE_SQL["op4_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM t), (VALUES (0), (1), (2)) AS v(j) WHERE c > 1 GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
         len(list_distinct(w)) AS n_different_words FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 100 * n_repeat_words > 30 * n_words
           OR 100 * n_capitals > 60 * word_chars OR 100 * n_digits > 40 * word_chars OR n_different_words < 15) AS kept
FROM f
"""

ORACLE_SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), a AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM a WINDOW o AS (ORDER BY 3 * source_size / weight, rank)
), t AS (
  SELECT source, rank, source_size, CASE WHEN 3 * source_size <= level * weight THEN CAST(3 * source_size AS DOUBLE)
         ELSE weight * (SELECT arg_min(level, 3 * source_size / weight) FROM l WHERE 3 * source_size > level * weight) END AS target FROM l
), q AS (
  SELECT d.*, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, source_size, target, size AS n, sum(size) OVER (ORDER BY CAST(e * source_size + upto AS DOUBLE) / target, rank, key, doc_id, e, size ROWS UNBOUNDED PRECEDING) AS running
  FROM q, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0
), k AS (
  SELECT doc_id, size, source_size, target, sum(CASE WHEN running <= (SELECT sum(size) FROM d) THEN n ELSE 0 END) AS taken FROM c GROUP BY doc_id, size, source_size, target
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM k
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM q WHERE size = 0 OR target = 0
"""
