"""DuckDB SQL of the queries on tables."""

from __future__ import annotations

_EXT = r"lower(regexp_extract(regexp_extract(url, '^https?://([^/?#]+)', 1), '[^.](\.[^.]+)$', 1))"
_ROUTED = f"routed AS (SELECT page_id, CASE WHEN {_EXT} IN ('.html', '.com') THEN 'web' WHEN {_EXT} IN ('.org') THEN 'numbered' ELSE 'ocr' END AS route FROM pages)"
_TOPK = """
scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)"""
_CLAIMS = """
sims AS (
  SELECT c.label, c.vec_id AS claim_id, coalesce(max(list_dot_product(c.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0) AS s
  FROM embeddings c LEFT JOIN embeddings e ON c.label = e.label AND e.vec_id % 5 <> 0 WHERE c.vec_id % 5 = 0 GROUP BY ALL
), reviewed AS (
  SELECT label, claim_id, round(s, 4) AS max_similarity, s >= 0.75 AS passed,
         CASE WHEN s >= 0.75 THEN NULL WHEN s < 0.2 THEN 'high' WHEN s < 0.75 * 0.7 THEN 'medium' ELSE 'low' END AS severity FROM sims
)"""
_CENTRES = """
centres AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY label),
near AS (SELECT e.label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) AS similarity FROM embeddings e JOIN centres USING (label))"""
_FEEDBACK = """
given AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'angry' ELSE 'negative' END AS kind, doc_id % 2 = 0 AS corrected FROM labels),
judged AS (SELECT doc_id, CASE WHEN kind = 'angry' THEN 'unknown sentiment' WHEN kind = 'negative' AND NOT corrected THEN 'correction required' END AS error, kind FROM given),
told AS (SELECT doc_id, error IS NULL AS valid, CASE WHEN error IS NOT NULL THEN 0 WHEN kind = 'positive' THEN 1 ELSE -1 END AS signal, error FROM judged)"""


def _prompt(template: str) -> str:
    from vellum.operators.retrieval import TEMPLATES

    text = TEMPLATES.get(template, template).replace("'", "''").replace("\n", "' || chr(10) || '")
    return "'" + text.replace("{chunks}", "' || chunks || '").replace("{question}", "Why?").replace("{context}", "ctx") + "'"


#: The text begins with a date of 16 characters, which the normaliser shortens by none: 29/02/2020 and 2020-02-29 are as long.
_EACH = """
judged AS (
  SELECT doc_id, length(text) + 16 AS size,
         CASE WHEN source = 'src3' THEN 'upload' WHEN n_chars = 0 THEN 'upload' WHEN n_chars > 10485 THEN 'upload' WHEN doc_id % 7 = 0 THEN 'plan' WHEN doc_id % 11 = 0 THEN 'dates' END AS node,
         CASE WHEN source = 'src3' THEN 'extension not allowed: .exe' WHEN n_chars = 0 THEN 'empty file' WHEN n_chars > 10485 THEN 'file too large'
              WHEN doc_id % 7 = 0 THEN 'reply is no JSON' WHEN doc_id % 11 = 0 THEN 'no such date: 31/02/2020' END AS error
  FROM documents
)"""

ORACLES = {
    "router_route": f"WITH {_ROUTED} SELECT page_id, route, 1.0::DOUBLE AS confidence FROM routed",
    "router_counts": f"WITH {_ROUTED} SELECT route, count(*) AS n FROM routed GROUP BY route",
    "branch_merge": f"WITH {_ROUTED} SELECT page_id, CASE route WHEN 'web' THEN 'html' ELSE 'other' END AS handled_by FROM routed",
    "upload_validation": """
WITH f AS (SELECT doc_id, ['.pdf', '.TXT', '.exe', '', '.csv'][doc_id % 5 + 1] AS x, n_chars * 20000 AS size FROM documents),
e AS (SELECT *, lower(x) AS extension FROM f),
j AS (SELECT *, CASE WHEN extension NOT IN ('.pdf', '.txt', '.csv') THEN 'extension not allowed: ' || extension WHEN size = 0 THEN 'empty file' WHEN size > 52428800 THEN 'file too large' END AS error FROM e)
SELECT doc_id, extension, CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.txt' THEN 'text/plain' WHEN '.csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS mime_type,
       error IS NULL AS valid, error FROM j""",
    "batch_validation": """
SELECT source, count(*) AS document_count, count(*) FILTER (WHERE n_chars = 0 OR n_chars * 3000 > 52428800) AS failed,
       count(*) FILTER (WHERE n_chars = 0 OR n_chars * 3000 > 52428800) = 0 AS accepted FROM documents GROUP BY source""",
    "corpus_stats": "SELECT source, count(*) AS document_count, sum(n_chars)::BIGINT AS total_size_bytes, string_agg(DISTINCT lang, ',' ORDER BY lang) AS extensions FROM documents GROUP BY source",
    "corpus_dedup_first": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "corpus_union": """
SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 1 THEN 'found' ELSE 'missing' END AS state FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""",
    "library_upsert_latest": "SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "library_list_recent": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100",
    "library_reconcile": """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN 'kept' WHEN doc_id % 5 > 0 THEN 'adopted' ELSE 'dropped' END AS state FROM documents WHERE doc_id % 3 > 0 OR doc_id % 5 > 0""",
    "vector_topk_per_query": f"WITH {_TOPK} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::INT AS dimension FROM embeddings",
    "knn_label_vote": f"""
WITH {_TOPK}, v AS (SELECT query_id, label, count(*) AS n FROM ranked JOIN embeddings USING (vec_id) WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, label, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
    "positional_chunk_join": """
SELECT conv_id, turn AS index, vec_id, length(text) AS chars FROM conversations LEFT JOIN embeddings ON conv_id = vec_id % 100 AND turn = vec_id // 100""",
    "prompt_templates": f"""
WITH r AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS i FROM conversations),
c AS (SELECT conv_id, string_agg('[' || i || '] ' || text || CASE WHEN role <> 'system' THEN ' (source: ' || role || ')' ELSE '' END, chr(10) || chr(10) ORDER BY i) AS chunks FROM r GROUP BY conv_id)
SELECT conv_id, md5({_prompt('qa_concise')}) AS qa_concise, md5({_prompt('summary')}) AS summary,
       md5('[SYSTEM]' || chr(10) || 'Be brief.' || chr(10) || chr(10) || '[USER]' || chr(10) || {_prompt('{context}|{chunks}|{question}')}) AS custom FROM c""",
    "critic_embedding_claims": f"WITH {_CLAIMS} SELECT label, claim_id, max_similarity, passed, severity FROM reviewed",
    "critic_score": f"""
WITH {_CLAIMS}, s AS (SELECT label, count(*) AS total_claims, count(*) FILTER (WHERE passed) AS passed_claims, coalesce(bool_or(severity = 'high'), false) AS high FROM reviewed GROUP BY label),
c AS (SELECT *, passed_claims / total_claims AS a, CASE WHEN high THEN greatest(0, passed_claims / total_claims - 0.3) ELSE passed_claims / total_claims END AS k FROM s)
SELECT label, total_claims, passed_claims, round(k, 4) AS confidence_score, round(a, 4) AS source_alignment, k >= 0.7 AND NOT high AS is_supported FROM c""",
    "critic_hybrid": r"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
answers AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id),
pieces AS (
  SELECT conv_id, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS claim, i FROM (
    SELECT conv_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS x FROM answers), unnest(range(1, len(x) + 1)) AS t(i)
), claims AS (
  SELECT conv_id, claim, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS w FROM pieces WHERE length(claim) > 5
), sims AS (
  SELECT c.conv_id, n, claim, coalesce(max(len(list_intersect(w, regexp_extract_all(lower(t.text), '[a-z0-9]+'))) / nullif(len(w), 0)), 0) AS s
  FROM claims c LEFT JOIN turns t ON c.conv_id = t.conv_id AND t.role <> 'assistant' GROUP BY ALL
), judged AS (
  SELECT *, s >= 0.75 AS passed, round(s, 4) AS r FROM sims
), marks AS (
  SELECT *, CASE WHEN passed OR r >= 0.5 THEN NULL WHEN r < 0.2 THEN 'high' ELSE 'medium' END AS severity FROM judged
), summed AS (
  SELECT conv_id, count(*) AS total_claims, count(*) FILTER (WHERE passed) AS passed_claims, count(*) FILTER (WHERE severity IS NULL) / count(*) AS a, avg(r) AS alignment,
         coalesce(avg(r) FILTER (WHERE NOT passed), 0) AS flagged, bool_or(coalesce(severity = 'high', false)) AS high,
         coalesce(list(severity || ':' || claim ORDER BY severity, n) FILTER (WHERE severity IS NOT NULL), []) AS issues,
         coalesce(list(claim ORDER BY n) FILTER (WHERE severity = 'high'), []) AS wrong
  FROM marks GROUP BY conv_id
), full_ AS (
  SELECT conv_id, text, coalesce(total_claims, 0) AS total_claims, coalesce(passed_claims, 0) AS passed_claims, coalesce(a, 0) AS a, coalesce(high, false) AS high,
         coalesce(alignment, 0) AS alignment, coalesce(flagged, 0) AS flagged, coalesce(issues, []) AS issues, coalesce(wrong, []) AS wrong,
         CASE WHEN high THEN greatest(0, a - 0.3) ELSE coalesce(a, 0) END AS k
  FROM answers LEFT JOIN summed USING (conv_id)
)
SELECT conv_id, total_claims, passed_claims, round(k, 4) AS confidence_score, k >= 0.7 AND NOT high AND a >= 0.75 AS is_supported, round(alignment, 4) AS source_alignment,
       round(1 - flagged, 4) AS consistency, array_to_string(issues[:5], '|') AS issues, len(wrong) AS n_corrections,
       md5(list_reduce([text] || wrong, lambda t, c: CASE WHEN instr(t, c) > 0 THEN substr(t, 1, instr(t, c) - 1) || '(unverified) ' || c || substr(t, instr(t, c) + length(c)) ELSE t END)) AS corrected_md5
FROM full_""",
    "tfidf_top_terms": r"""
WITH t AS (
  SELECT doc_id, lang, term, count(*) AS tf FROM (
    SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\pL\pM][\pL\pM\pN\p{Pc}''-]+')) AS term FROM documents) GROUP BY ALL
), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT lang, term, round(sum((1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1)), 6) AS weight FROM t JOIN d USING (term) GROUP BY ALL)
SELECT lang, term, round(weight, 4) AS weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)::INT AS rank FROM w
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) <= 5""",
    "centroid_similarity": f"WITH {_CENTRES} SELECT label, vec_id, similarity FROM near",
    "topic_vocabulary": r"""
WITH runs AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(strip_accents(lower(text)), '[\pL\pM\pN\p{Pc}''-]+'),
    lambda r: regexp_extract(r, '(?:^|[''-])(\pL[\pL\pM\pN\p{Pc}''-]*[\pL\pM\pN\p{Pc}])', 1)), lambda r: r <> '') AS w FROM documents
), words AS (
  SELECT unnest(w) AS term FROM runs UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM runs, unnest(range(1, len(w))) AS t(i)
), chars AS (
  SELECT ' ' || p || ' ' AS p, count(*) AS tf FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS p FROM documents) WHERE p <> '' GROUP BY p
), grams AS (
  SELECT substr(p, i, n) AS term, tf FROM chars, unnest([3, 4, 5]) AS s(n), unnest(range(1, greatest(length(p) - n + 2, 1))) AS t(i)
), counts AS (
  SELECT 'w' AS kind, term, count(*) AS n FROM words GROUP BY term UNION ALL SELECT 'c', term, sum(tf)::BIGINT FROM grams GROUP BY term
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) - 1)::INT AS r FROM counts
)
SELECT kind, term, n, (r + CASE kind WHEN 'c' THEN 16000 ELSE 0 END)::INT AS "at" FROM ranked WHERE r < CASE kind WHEN 'w' THEN 16000 ELSE 10000 END""",
    "cluster_representatives": f"""
WITH {_CENTRES} SELECT label AS cluster, count(*) AS documents, round(avg(similarity), 4) AS avg_similarity,
  (list(vec_id ORDER BY similarity DESC, vec_id))[1] AS representative FROM near GROUP BY label""",
    "feedback_validate": f"WITH {_FEEDBACK} SELECT doc_id, valid, signal, error FROM told",
    "feedback_signal": f"WITH {_FEEDBACK} SELECT signal, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS rejected FROM told GROUP BY signal",
    "for_each_counts": f"WITH {_EACH} SELECT count(*) AS total, count(*) FILTER (WHERE node IS NULL) AS succeeded, count(node) AS failed FROM judged",
    "for_each_failures": f"WITH {_EACH} SELECT node, error, count(*) AS n FROM judged WHERE node IS NOT NULL GROUP BY ALL",
    "table_shape": "SELECT conv_id, count(*) FILTER (WHERE role <> 'assistant')::INT AS n_rows, count(*) FILTER (WHERE role = 'assistant')::INT AS n_columns FROM conversations GROUP BY conv_id",
    "extension_order_revenue": """
SELECT n_name, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS revenue_cents, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "extension_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extension_top_orders": """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
    "extension_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "extension_event_sessions": """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
    "chunk_source_counts": """
SELECT source, sum(greatest(1, ceil(length(text) / 1000.0)))::BIGINT AS chunks, max(greatest(1, ceil(length(text) / 1000.0)) - 1)::INT AS last_index
FROM documents WHERE regexp_matches(text, '\\S') GROUP BY source""",
    "workflow_run_report": f"""
WITH {_EACH}, n AS (
  SELECT count(*) AS a, count(*) FILTER (WHERE node = 'upload') AS u, count(*) FILTER (WHERE node = 'plan') AS p, count(*) FILTER (WHERE node = 'dates') AS d,
         sum(CASE WHEN node IS NOT NULL THEN 0 WHEN size <= 512 THEN 1 ELSE 1 + ceil((size - 512) / 412.0) END)::BIGINT AS chunks
  FROM judged
)
SELECT 'upload' AS node, 0 AS level, 'success' AS status, a AS rows_in, a - u AS rows_out, u AS failed FROM n
UNION ALL SELECT 'plan', 1, 'success', a - u, a - u - p, p FROM n
UNION ALL SELECT 'dates', 2, 'success', a - u - p, a - u - p - d, d FROM n
UNION ALL SELECT 'split', 3, 'success', a - u - p - d, chunks, 0 FROM n""",
}
