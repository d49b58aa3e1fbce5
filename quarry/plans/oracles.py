"""DuckDB SQL for the queries of ``plans.queries``."""

from __future__ import annotations

from quarry.functions.text import STOP_WORDS
from quarry.functions.urls import TRACKING

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEEP = f"length(term) BETWEEN 2 AND 40 AND term NOT IN ({_STOP})"
_WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"


def _tokens(source: str, text: str = "text") -> str:
    return f"(SELECT doc_id, term FROM (SELECT doc_id, lower(unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM {source}) WHERE {_KEEP})"


def _index(source: str = "documents") -> str:
    """CTEs tok, post, df, dl, st over a relation (doc_id, text)."""
    return f"""tok AS {_tokens(source)},
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
dl AS (SELECT d.doc_id, count(t.term) AS doc_length FROM {source} d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, coalesce(avg(doc_length), 0) AS avgdl FROM dl)"""


_SCORE = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(doc_length, 1) / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END))"


def _bm25(terms: str) -> str:
    return f"""hits AS (SELECT doc_id, sum({_SCORE}) AS bm25, string_agg(term, ' ' ORDER BY term) AS matched, count(*) AS n_matched FROM post JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ({terms}) GROUP BY doc_id HAVING sum({_SCORE}) > 0)"""


_Q = "'ertion', 'heon', 'thea'"
_BASE = f"WITH {_index()}, {_bm25(_Q)}"


def _decoded(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _text_of(x: str) -> str:
    return f"trim(regexp_replace({_decoded(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


_TITLE = _text_of("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_BODY = _text_of("regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')")
_PAGES = f"pg AS (SELECT page_id AS doc_id, url, {_TITLE} AS title, {_BODY} AS text FROM pages)"
_TRACK = ", ".join(f"'{t}'" for t in TRACKING)
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _normal(u: str) -> str:
    pairs = f"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT list_contains([{_TRACK}], lower(regexp_extract(x, '^([^=]+)=', 1)))))"
    path = f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
    return f"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({pairs}) = 0 THEN '' ELSE '?' || array_to_string({pairs}, '&') END"


_LINKS = rf"""lk AS (SELECT page_id, url, i, CASE WHEN regexp_matches(h, '^/[^/]|^/$') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h ELSE h END AS u
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["'']', 1), 1) AS i FROM pages)),
ln AS (SELECT page_id, url, i, {_normal("u")} AS target FROM lk WHERE regexp_matches(u, '(?i)^https?://[^/?#]')),
lf AS (SELECT page_id, url, target, min(i) AS i FROM ln GROUP BY ALL)"""

_FP = rf"array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda w: w <> '' AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'is', 'in')), lambda w: trim(w, '.,;:!?\"''()[]{{}}')), lambda w: w <> ''), ' ')"
_RANK = f"""{_PAGES}, {_index("pg")}, {_bm25("'ertion', 'page', 'thea'")},
sig AS (SELECT h.doc_id, url, bm25,
  CASE WHEN tl = 0 THEN 0.0 ELSE (CAST(list_contains(tt, 'ertion') AS INT) + CAST(list_contains(tt, 'thea') AS INT) + CAST(list_contains(tt, 'page') AS INT)) / 3.0::DOUBLE END AS title_score,
  (CAST(contains(lower(url), 'ertion') AS INT) + CAST(contains(lower(url), 'thea') AS INT) + CAST(contains(lower(url), 'page') AS INT)) / 3.0::DOUBLE AS url_score,
  0.5::DOUBLE AS freshness_score, CASE WHEN avgdl <= 0 THEN 0.5 WHEN doc_length <= 0 THEN 0 ELSE 1 / (1 + exp(-(doc_length / avgdl - 1))) END AS quality_score
  FROM hits h JOIN (SELECT doc_id, url, list_filter(list_transform(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t)), lambda t: length(t) BETWEEN 2 AND 40 AND t NOT IN ({_STOP})) AS tt, len(tt) AS tl FROM pg) USING (doc_id) JOIN dl USING (doc_id), st),
fin AS (SELECT *, bm25 + 1.5::DOUBLE * title_score + 0.5::DOUBLE * url_score + 0.3::DOUBLE * freshness_score + 0.3::DOUBLE * quality_score AS final FROM sig)"""
_TFIDF = """raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN df USING (term), st),
tw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_COS = """qr AS (SELECT term, (1 + ln(qtf)) * (ln((n + 1) / (df + 1)) + 1) AS qw FROM (VALUES ('ertion', 1), ('heon', 1), ('thea', 2)) AS v(term, qtf) JOIN df USING (term), st),
cs AS (SELECT doc_id, sum(weight * qw) / (SELECT sqrt(sum(qw * qw)) FROM qr) AS semantic FROM tw JOIN qr USING (term) GROUP BY doc_id)"""
_BATCH = f"""{_index()},
bq AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM benchmark) WHERE length(term) BETWEEN 2 AND 40 AND term NOT IN ({_STOP})),
bs AS (SELECT query_id, doc_id, round(sum({_SCORE}), 6) AS bm25 FROM bq JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM bs WHERE bm25 > 0)"""
_EVAL = f"""{_BATCH},
rel AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE trim(b.text) <> ''),
m AS (SELECT query_id, count(*) AS n_rel, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS d5, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10, min(rank) AS first
  FROM rel LEFT JOIN run USING (query_id, doc_id) GROUP BY query_id)"""
_STORED = f"""{_PAGES}, s AS (SELECT doc_id, url, CASE WHEN doc_id % 4 = 0 THEN title || ' (old)' ELSE title END AS title, sha256({_FP}) AS h FROM pg WHERE doc_id % 2 = 0)"""
_OUT = f"WITH {_STORED}, o AS (SELECT p.url AS canonical_url, CASE WHEN s.h IS NULL THEN 'inserted' WHEN s.h = p.h AND s.title = p.title THEN 'duplicate' ELSE 'updated' END AS outcome FROM (SELECT *, sha256({_FP}) AS h FROM pg) p LEFT JOIN s ON s.url = p.url)"


def _snip(terms: tuple[str, ...], length: int) -> str:
    hit = "least(" + ", ".join(f"CASE WHEN strpos(lower(text), '{t}') > 0 THEN strpos(lower(text), '{t}') - 1 END" for t in terms) + ")"
    either = "|".join(sorted(terms))
    return f"""sn AS (SELECT *, length(text) AS size, {hit} AS hit FROM src),
s2 AS (SELECT *, CASE WHEN hit IS NULL THEN size ELSE least(size, greatest(0, hit - {length // 2}) + {length}) END AS fin FROM sn),
s3 AS (SELECT *, CASE WHEN hit IS NULL THEN 0 ELSE greatest(0, fin - {length}) END AS beg FROM s2),
s4 AS (SELECT *, substring(text, CAST(beg + 1 AS BIGINT), CAST(fin - beg AS BIGINT)) AS w, CASE WHEN beg > 0 THEN '...' ELSE '' END AS a, CASE WHEN fin < size THEN '...' ELSE '' END AS z FROM s3),
s5 AS (SELECT *, a || w || z AS snippet, a || regexp_replace(w, '(?i)({either})', '<mark>\\1</mark>', 'g') || z AS highlighted FROM s4)"""


ORACLE_SQL: dict[str, str] = {
    "tokenize_counts": f"SELECT d.doc_id, count(t.term) AS n_tokens, count(DISTINCT t.term) AS n_terms FROM documents d LEFT JOIN {_tokens('documents')} t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
    "token_positions": rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS i FROM documents),
o AS (SELECT doc_id, lower(p) AS term, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM p)
SELECT doc_id, count(*) AS n, CAST(sum(position) AS BIGINT) AS position_sum, CAST(min(position) AS INT) AS first, CAST(max(position) AS INT) AS last FROM o WHERE regexp_matches(p, '^[\p{{L}}\p{{N}}_]') AND {_KEEP} GROUP BY doc_id""",
    "stopword_filter": f"SELECT term, count(*) AS dropped FROM (SELECT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM documents) WHERE term IN ({_STOP}) AND length(term) BETWEEN 2 AND 40 GROUP BY term",
    "postings": f"WITH {_index()} SELECT term, doc_id, tf FROM post",
    "postings_positions": rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS i FROM documents),
o AS (SELECT doc_id, lower(p) AS term, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM p)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, CAST(min(position) AS INT) AS first_position FROM o WHERE regexp_matches(p, '^[\p{{L}}\p{{N}}_]') AND {_KEEP} GROUP BY term""",
    "term_df": f"WITH {_index()} SELECT term, df FROM df",
    "doc_lengths": f"WITH {_index()} SELECT doc_id, doc_length, CAST(0 AS BIGINT) AS title_length FROM dl",
    "index_stats": f"WITH {_index()} SELECT n AS num_documents, (SELECT count(*) FROM df) AS num_terms, (SELECT count(*) FROM post) AS total_postings, (SELECT CAST(sum(doc_length) AS BIGINT) FROM dl) AS total_document_length, round(avgdl, 6) AS avg_document_length FROM st",
    "vocabulary_top": f"WITH {_index()} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50",
    "remove_document": f"WITH src AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_index('src')} SELECT n AS num_documents, (SELECT count(*) FROM df) AS num_terms, (SELECT count(*) FROM post) AS total_postings, (SELECT CAST(sum(doc_length) AS BIGINT) FROM dl) AS total_document_length, round(avgdl, 6) AS avg_document_length FROM st",
    "snapshot_digest": f"""WITH {_index()} SELECT term, CAST(NULL AS BIGINT) AS doc_id, sha256('{{"term":"' || term || '","postings":[' || string_agg('{{"doc_id":' || doc_id || ',"tf":' || tf || '}}', ',' ORDER BY doc_id) || ']}}') AS line_sha256 FROM post GROUP BY term, doc_id // 65536
UNION ALL SELECT NULL, doc_id, sha256('{{"doc_id":' || doc_id || ',"url":"","title":"","doc_length":' || doc_length || ',"title_length":0}}') FROM dl""",
    "bm25_topk": f"{_BASE} SELECT doc_id, round(bm25, 6) AS bm25, matched FROM hits ORDER BY hits.bm25 DESC, doc_id LIMIT 10",
    "bm25_page2": f"{_BASE} SELECT doc_id, round(bm25, 6) AS bm25 FROM hits ORDER BY hits.bm25 DESC, doc_id LIMIT 10 OFFSET 10",
    "bm25_count": f"{_BASE} SELECT count(*) AS total FROM hits",
    "bm25_multi_query": f"WITH {_BATCH} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM run WHERE rank <= 10",
    "matched_terms": f"{_BASE} SELECT CAST(n_matched AS INT) AS n_matched, count(*) AS n_docs FROM hits GROUP BY n_matched",
    "retriever_join": f"{_BASE}, top AS (SELECT doc_id, bm25 FROM hits ORDER BY bm25 DESC, doc_id LIMIT 10), src AS (SELECT doc_id, bm25, text FROM documents JOIN top USING (doc_id)), {_snip(('ertion', 'heon', 'thea'), 240)} SELECT doc_id, round(bm25, 6) AS bm25, snippet, highlighted FROM s5",
    "snippet_window": f"WITH src AS (SELECT doc_id, text FROM documents), {_snip(('ertion', 'thea'), 120)} SELECT doc_id, snippet, highlighted FROM s5",
    "rank_signals": f"WITH {_RANK} SELECT doc_id, round(title_score, 6) AS title_score, round(url_score, 6) AS url_score, round(freshness_score, 6) AS freshness_score, round(quality_score, 6) AS quality_score FROM sig",
    "rank_topk": f"WITH {_RANK} SELECT doc_id, url, round(bm25, 6) AS bm25, round(final, 6) AS final FROM fin ORDER BY fin.final DESC, doc_id LIMIT 10",
    "rank_bm25_only": f"WITH {_RANK} SELECT doc_id, round(bm25, 6) AS final FROM fin ORDER BY fin.bm25 DESC, doc_id LIMIT 10",
    "rank_explain": f"WITH {_RANK}, top AS (SELECT * FROM fin ORDER BY final DESC, doc_id LIMIT 10) SELECT doc_id, signal, round(score, 6) AS score FROM (SELECT doc_id, unnest(['bm25', 'final', 'title', 'url', 'freshness', 'quality']) AS signal, unnest([bm25, final, title_score, url_score, freshness_score, quality_score]) AS score FROM top)",
    "suggestions": f"WITH {_index()} SELECT 'onan ert ' || term AS suggestion FROM df WHERE starts_with(term, 'ert') AND term <> 'ert' ORDER BY term LIMIT 10",
    "tfidf_weights": f"WITH {_index()}, {_TFIDF} SELECT doc_id, count(*) AS n_terms, round(max(weight), 6) AS max_weight, round(sum(weight), 5) AS sum_weight FROM tw GROUP BY doc_id",
    "tfidf_cosine": f"WITH {_index()}, {_TFIDF}, {_COS} SELECT doc_id, round(semantic, 6) AS semantic FROM cs ORDER BY round(cs.semantic, 6) DESC, doc_id LIMIT 20",
    "vector_topk": "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 10",
    "hybrid_topk": f"{_BASE}, {_TFIDF}, {_COS}, near AS (SELECT dl.doc_id, coalesce(semantic, 0) AS semantic FROM dl LEFT JOIN cs ON dl.doc_id = cs.doc_id ORDER BY 2 DESC, 1 LIMIT 50), b AS (SELECT coalesce(h.doc_id, near.doc_id) AS doc_id, coalesce(bm25, 0) / (SELECT max(bm25) FROM hits) AS bm25, coalesce(semantic, 0) AS semantic FROM hits h FULL OUTER JOIN near ON h.doc_id = near.doc_id) SELECT doc_id, round(bm25, 6) AS bm25, round(semantic, 6) AS semantic, round(b.bm25 + b.semantic, 6) AS final FROM b ORDER BY b.bm25 + b.semantic DESC, doc_id LIMIT 10",
    "content_hash": f"SELECT doc_id, sha256({_FP}) AS content_hash FROM documents",
    "duplicate_groups": f"SELECT sha256({_FP}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "ingest_counts": f"{_OUT} SELECT CAST(count(*) FILTER (outcome = 'inserted') AS BIGINT) AS inserted, CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS updated, CAST(count(*) FILTER (outcome = 'duplicate') AS BIGINT) AS duplicates, 0::BIGINT AS failed FROM o",
    "vectors_after_changes": "SELECT vec_id, CAST(label + CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 0 END AS BIGINT) AS label FROM embeddings WHERE vec_id % 5 <> 0",
    "index_outcomes": f"{_OUT} SELECT * FROM o",
    "indexing_counters": f"{_OUT} SELECT outcome, count(*) AS n FROM o GROUP BY outcome",
    "assign_doc_ids": "SELECT url AS canonical_url, CASE WHEN page_id % 2 = 0 THEN page_id ELSE (SELECT max(page_id) FROM pages WHERE page_id % 2 = 0) + row_number() OVER (PARTITION BY page_id % 2 ORDER BY url) END AS doc_id FROM pages",
    "upsert_latest": "SELECT lower(regexp_extract(url, '://([^/]*)', 1)) AS host, max(page_id) AS last_page FROM pages GROUP BY 1",
    "document_links": f"WITH {_LINKS} SELECT source, string_agg(target, ' ' ORDER BY target) AS targets FROM (SELECT DISTINCT {_normal('url')} AS source, target FROM lf) GROUP BY source",
    "exists_by_hash": f"WITH {_STORED} SELECT doc_id, sha256({_FP}) AS content_hash FROM pg WHERE sha256({_FP}) IN (SELECT h FROM s)",
    "point_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17",
    "scan_first": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_language": "SELECT page_id, nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']?([^\"''\\s>]+)', 1), '') AS language FROM pages",
    "page_body": f"SELECT page_id, {_BODY} AS body FROM pages",
    "page_headings": f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: {_text_of('h')}), lambda h: h <> ''), '|') AS headings FROM pages",
    "page_links": f"WITH {_LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position, target FROM lf",
    "url_normalize": f"SELECT page_id, {_normal('url')} AS normalized FROM pages",
    "url_normalize_exact": f"SELECT page_id, {_normal('url')} AS normalized, {_HOST} AS host, {_HOST} AS netloc FROM pages",
    "domains": "SELECT lower(regexp_extract(url, '://([^/]*)', 1)) AS host, count(*) AS n_pages FROM pages GROUP BY 1",
    "link_graph": f"WITH {_LINKS} SELECT DISTINCT {_normal('url')} AS source, target FROM lf",
    "crawl_bfs": f"WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT {_normal('url')} AS source, target FROM lf), r(url, depth) AS (SELECT {_normal('url')}, 0 FROM pages WHERE page_id < 20 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.url WHERE r.depth < 4) SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE url IS NOT NULL GROUP BY url",
    "crawl_stats": f"SELECT CASE WHEN page_id % 11 = 0 THEN 'failed' WHEN strlen(html) > 3000 THEN 'too_large' WHEN html = '' AND {_TITLE} = '' THEN 'skipped' ELSE 'fetched' END AS outcome, count(*) AS n FROM pages GROUP BY 1",
    "allowlist": f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id < 20)",
    "host_guard": f"""WITH h AS (SELECT {_HOST} AS host FROM pages UNION SELECT (user_id % 256) || '.' || (event_id % 256) || '.0.1' FROM events UNION SELECT unnest(['localhost', 'a.local', 'b.internal', '8.8.8.8', '192.168.1.1', '169.254.169.254', ''])),
o AS (SELECT host, regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AS lit, TRY_CAST(string_split(host, '.')[1] AS INT) AS a, TRY_CAST(string_split(host, '.')[2] AS INT) AS b, TRY_CAST(string_split(host, '.')[3] AS INT) AS c FROM h)
SELECT host, host = '' OR host IN ('localhost') OR ends_with(host, '.local') OR ends_with(host, '.internal') OR (lit AND (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))) AS blocked FROM o""",
    "robots_gate": "SELECT page_id, NOT starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/6') AS allowed FROM pages",
    "robots_exact": "SELECT page_id, NOT starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/6') AS allowed, 1.5::DOUBLE AS crawl_delay FROM pages",
    "same_site": f"SELECT p.page_id, {_HOST.replace('url', 'p.url')} = {_HOST.replace('url', 'q.url')} AND lower(split_part(p.url, ':', 1)) = lower(split_part(q.url, ':', 1)) AS same FROM pages p JOIN pages q ON q.page_id = p.page_id + 1",
    "politeness": "SELECT event_id, round(greatest(0, 600.0::DOUBLE - coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6::DOUBLE, 600)), 3) AS wait FROM events",
    "precision_recall": f"WITH {_EVAL} SELECT query_id, round(h5 / 5, 6) AS p_at_5, round(h10 / 10, 6) AS p_at_10, round(h5 / n_rel, 6) AS r_at_5, round(h10 / n_rel, 6) AS r_at_10 FROM m",
    "mrr": f"WITH {_EVAL} SELECT round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m",
    "ndcg": f"WITH {_EVAL}, i AS (SELECT *, list_sum(list_transform(range(1, least(5, n_rel) + 1), lambda r: 1 / log2(r + 1))) AS i5, list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda r: 1 / log2(r + 1))) AS i10 FROM m) SELECT query_id, round(d5 / i5, 6) AS ndcg_at_5, round(d10 / i10, 6) AS ndcg_at_10 FROM i",
    "latency_percentiles": "WITH v AS (SELECT list_sort(list(value)) AS v FROM events) SELECT p::DOUBLE AS p, v[CAST(floor(p::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS value FROM v, (VALUES (0.5), (0.95), (0.99)) AS t(p)",
    "stream_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
}
# what a round trip or an unchanged text must give is what the index itself gives
ORACLE_SQL["snapshot_round_trip"] = ORACLE_SQL["index_stats"]
# greedy by client in order of time: a request is admitted if the last admitted one is a minute ago or more (limit 1)
ORACLE_SQL["rate_limit"] = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), r AS (
  SELECT event_id, user_id, k, t AS kept, true AS allowed FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - r.kept >= 60000000 THEN e.t ELSE r.kept END, e.t - r.kept >= 60000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1
)
SELECT event_id, user_id, allowed FROM r
"""
_MATCHED = "(SELECT string_agg(term, ' ' ORDER BY term) FROM post WHERE post.doc_id = fin.doc_id AND term IN ('ertion', 'page', 'thea'))"
ORACLE_SQL["search_page"] = f"WITH {_RANK}, n AS (SELECT count(*) AS total FROM fin) SELECT fin.doc_id, total, 2::BIGINT AS page, round(final, 6) AS score, pg.title, fin.url, {_MATCHED} AS matched FROM fin JOIN pg USING (doc_id), n ORDER BY fin.final DESC, fin.doc_id LIMIT 5 OFFSET 5"
ORACLE_SQL["plain_page"] = f"WITH {_RANK} SELECT fin.doc_id, round(bm25, 6) AS score, pg.title, fin.url FROM fin JOIN pg USING (doc_id) ORDER BY fin.bm25 DESC, fin.doc_id LIMIT 10"
ORACLE_SQL["ingest_documents"] = f"{_OUT}, ids AS ({ORACLE_SQL['assign_doc_ids']}) SELECT ids.doc_id, pg.url AS canonical_url, title, sha256({_FP}) AS content_hash, CAST(length(text) AS BIGINT) AS body_length FROM pg JOIN ids ON ids.canonical_url = pg.url"
