"""DuckDB SQL of the text queries."""

from __future__ import annotations

_CHUNKS = """
chunks AS (
  SELECT d.doc_id, d.lang, d.source, i AS index, substr(d.text, (412 * i + 1)::BIGINT, 512) AS text,
         412 * i AS char_start, least(412 * i + 512, length(d.text)) AS char_end
  FROM documents d,
       unnest(range(0, CASE WHEN length(d.text) <= 512 THEN 1 ELSE 1 + ceil((length(d.text) - 512) / 412.0)::BIGINT END)) AS t(i)
  WHERE regexp_matches(d.text, '\\S')
)"""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _clean(x: str) -> str:
    joined = rf"regexp_replace({x}, '-\s*\n\s*([a-zà-ÿ])', '\1', 'g')"
    spaced = rf"regexp_replace(regexp_replace({joined}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
    lines = f"array_to_string(list_transform(string_split({spaced}, chr(10)), lambda x: {_strip('x')}), chr(10))"
    return _strip(lines)


_DIRTY = "replace(replace(replace(text, 'th', 't-' || chr(10) || 'h'), '. ', '.  ' || chr(9) || ' '), ', ', ',' || repeat(chr(10), 4) || ' ')"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_DATE = "strftime(o_orderdate, '%Y-%m-%d')"

#: An address is bounded by characters that no address has; every numeric token is bracketed, so that its bounds can be seen.
_IPS = rf"""
ips AS (
  SELECT doc_id, v[2:-2] AS v FROM (
    SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\d+(\.\d+)*', '<\0>', 'g'), '<\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}>')) AS v FROM documents)
)"""

_EMAIL_SPANS = f"""
parts AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents WHERE regexp_matches(text, '{_EMAIL}')),
begun AS (SELECT doc_id, m[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS s
          FROM parts, unnest(range(1, len(m) + 1)) AS t(i)),
spans AS (SELECT doc_id, s, (s + length(value))::INT AS e FROM begun)"""

_RULES = r"""
found AS (
  SELECT doc_id, 'contact' AS category, 'email' AS name, true AS required, nullif(regexp_extract(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), '') AS value, 0.8 AS sure, true AS ok FROM documents
  UNION ALL
  SELECT doc_id, 'secret', 'secret', false, nullif(regexp_extract(text, '(?i)token = "([0-9a-f]+)"', 1), ''), 0.9, length(regexp_extract(text, '(?i)token = "([0-9a-f]+)"', 1)) = 40 FROM documents
  UNION ALL
  SELECT doc_id, 'general', 'first_word', true, nullif(regexp_extract(text, '(?i)[a-z]+'), ''), 0.9, length(regexp_extract(text, '(?i)[a-z]+')) <= 8 FROM documents
), judged AS (
  SELECT *, value IS NOT NULL AND ok AS found FROM found
)"""

_GAPS = r"""
rules AS (
  SELECT * FROM (VALUES ('email', 'CRITICAL', '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), ('ip', 'WARNING', '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'),
    ('token', 'INFO', '(?i)token = '), ('the', 'CRITICAL', '(?i)(^|[^\pL\pN_])(the|der|el|le)([^\pL\pN_]|$)')) AS t(field, severity, pattern)
), fields AS (
  SELECT doc_id, field, severity, CASE WHEN regexp_matches(text, pattern) THEN 'MATCHED' ELSE 'GAP' END AS status, 'regex' AS method FROM documents, rules
  UNION ALL SELECT doc_id, 'tone', 'INFO', 'UNEVALUATED', 'skipped' FROM documents
)"""


def _languages(mode: str) -> str:
    from vellum.operators.language import STOP_WORDS

    words = ", ".join(f"('{lang}', [{', '.join(repr(w) for w in own)}])" for lang, own in STOP_WORDS.items())
    parts = "unnest([text])" if mode == "document" else "unnest(string_split(text, chr(10)))"
    return rf"""
langs AS (SELECT * FROM (VALUES {words}) AS t(lang, own)),
segs AS (SELECT doc_id, row_number() OVER () AS pos, {_strip('seg')} AS seg FROM (SELECT doc_id, {parts} AS seg FROM documents)),
worth AS (
  SELECT doc_id, pos, lang, len(list_filter(regexp_split_to_array(lower(seg), '[^a-zà-ÿœ\x{{0600}}-\x{{06FF}}]+'), lambda w: list_contains(own, w))) AS hits
  FROM segs, langs WHERE length(regexp_replace(seg, '[^a-zA-Z]', '', 'g')) >= 3
), hits AS (
  SELECT doc_id, pos, lang, hits FROM worth UNION ALL
  SELECT doc_id, 0, langs.lang, len(list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿœ\x{{0600}}-\x{{06FF}}]+'), lambda w: list_contains(own, w)))
  FROM documents, langs WHERE doc_id NOT IN (SELECT doc_id FROM worth WHERE hits > 0)
), shares AS (SELECT doc_id, lang, hits, hits / sum(hits) OVER (PARTITION BY doc_id, pos) AS p FROM hits),
means AS (SELECT doc_id, lang, round(avg(p), 4) AS probability FROM shares WHERE hits > 0 GROUP BY doc_id, lang),
ranked AS (
  SELECT doc_id, lang, probability, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, lang)::INT AS rank FROM means WHERE probability >= 0.1
), detected AS (
  SELECT * FROM ranked WHERE rank <= 5
  UNION ALL SELECT doc_id, 'unknown', 0.0, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ranked)
)"""


_MODEL = r"""
folded AS (
  SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\pL]+', ' ', 'g')) || ' ' AS s FROM documents WHERE regexp_matches(text, '\pL')
), codes AS (
  SELECT doc_id, lang, list_transform(string_split(s, ''), lambda x: unicode(x)::BIGINT) AS c FROM folded
), grams AS (
  SELECT doc_id, lang, unnest(list_concat(
    list_transform(c, lambda x: x % 8191),
    list_transform(range(1, len(c)), lambda i: (c[i] * 257 + c[i + 1]) % 8191 + 8191),
    list_transform(range(1, len(c) - 1), lambda i: ((c[i] * 257 + c[i + 1]) * 257 + c[i + 2]) % 8191 + 16382))) AS g FROM codes
), counts AS (
  SELECT lang, g, count(*) AS n FROM grams WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, g // 8191 AS o, sum(n) AS t FROM counts GROUP BY ALL
), model AS (
  SELECT lang, g, coalesce(n, 0) AS n, round(1000 * ln((coalesce(n, 0) + 0.5) / (t + 4095.5)))::BIGINT AS w
  FROM (SELECT lang, t, o * 8191 + b AS g FROM totals, range(8191) AS r(b)) LEFT JOIN counts USING (lang, g)
), fit AS (
  SELECT lang, sum(n * w) / sum(n) AS m, sqrt(greatest(0, sum(n * w * w) / sum(n) - (sum(n * w) / sum(n)) * (sum(n * w) / sum(n)))) AS d FROM model GROUP BY lang
), bags AS (
  SELECT doc_id, g, count(*) AS k FROM grams GROUP BY ALL
), scored AS (
  SELECT doc_id, model.lang, sum(k * w) AS score, sum(k) AS n FROM bags JOIN model USING (g) GROUP BY ALL
), best AS (
  SELECT s.*, max(score) OVER (PARTITION BY doc_id) AS top, (m - 300) * n - 6 * d * sqrt(n) AS least FROM scored AS s JOIN fit USING (lang)
), odds AS (
  SELECT doc_id, lang, exp((score - top) / 3000.0) AS p, bool_or(score = top AND score >= least) OVER (PARTITION BY doc_id) AS known FROM best
), ranked AS (
  SELECT doc_id, lang, round(p, 4) AS probability, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 4) DESC, lang)::INT AS rank
  FROM (SELECT doc_id, lang, p / sum(p) OVER (PARTITION BY doc_id) AS p FROM odds WHERE known) WHERE round(p, 4) >= 0.1
)"""

ORACLES = {
    "splitter_chunks": f"WITH {_CHUNKS} SELECT doc_id, index::INT AS index, char_start::INT AS char_start, char_end::INT AS char_end, md5(text) AS text_md5 FROM chunks",
    "splitter_stats": f"""
WITH {_CHUNKS}
SELECT lang, source, count(*) AS chunk_count, sum(char_end - char_start)::BIGINT AS total_chars,
       round(avg(char_end - char_start), 1) AS avg_chunk_size
FROM chunks GROUP BY lang, source""",
    "index_chunks_trimmed": f"""
WITH {_CHUNKS}, t AS (SELECT doc_id, {_strip('text')} AS t FROM chunks)
SELECT doc_id, count(*) AS chunks, sum(length(t))::BIGINT AS chars FROM t WHERE t <> '' GROUP BY doc_id""",
    "clean_text": f"""
WITH d AS (SELECT doc_id, {_DIRTY} AS text FROM documents), c AS (SELECT doc_id, text, {_clean('text')} AS cleaned FROM d)
SELECT doc_id, md5(cleaned) AS cleaned_md5, length(text) AS original_length, length(cleaned) AS cleaned_length, length(text) - length(cleaned) AS chars_removed FROM c""",
    "workflow_chunks": f"""
WITH c AS (SELECT source, lower({_clean('text')}) AS t FROM documents), n AS (SELECT source, length(t) AS n FROM c WHERE regexp_matches(t, '\\S')),
k AS (SELECT source, n, CASE WHEN n <= 256 THEN 1 ELSE 1 + ceil((n - 256) / 200.0)::BIGINT END AS k FROM n)
SELECT source, sum(k)::BIGINT AS chunks, sum(n + 56 * (k - 1))::BIGINT AS chars FROM k GROUP BY source""",
    "clean_upper": f"SELECT doc_id, md5(upper(replace({_clean('text')}, 'ß', 'SS'))) AS cleaned_md5 FROM documents",
    "strip_special_stats": r"""
WITH s AS (SELECT lang, length(text) - length(regexp_replace(text, '[^\pL\pM\pN\p{Pc}\s.,;:!?()\[\]/%€$@''"-]', '', 'g')) AS n FROM documents)
SELECT lang, sum(n)::BIGINT AS removed, count(*) FILTER (WHERE n > 0) AS changed FROM s GROUP BY lang""",
    "digit_fold": "SELECT doc_id, true AS same, md5(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS east_md5, md5(text) AS folded_md5 FROM documents",
    "dates_numeric_normalized": f"SELECT o_orderkey, 'Ordered on ' || {_DATE} || ', due 2030-01-31.' AS normalized_text, 2::BIGINT AS n_dates FROM orders",
    "date_format_variants": """
SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('minute', ts), '%d/%m/%Y %H:%M:%S') AS dmy,
       strftime(date_trunc('minute', ts), '%m/%d/%Y %H:%M:%S') AS mdy FROM events""",
    "dates_by_month_name": f"SELECT o_orderkey, {_DATE} AS iso_date FROM orders",
    "dates_relative": """
WITH o AS (
  SELECT o_orderkey, o_orderkey % 8 AS kind, o_orderdate::DATE AS d, (o_custkey % 90 + 1)::INT AS n FROM orders
), t AS (
  SELECT *, (d + to_days(n))::DATE AS days, (d - to_days(7 * n))::DATE AS weeks, (d - to_months(n))::DATE AS months, (d + to_months(1))::DATE AS month, (d + to_years(n))::DATE AS years,
         (d - to_years(1))::DATE AS year, (d + to_days(1))::DATE AS morrow, (d + to_days((8 - isodow(d) + 0)::INT))::DATE AS monday, (d - to_days(CASE WHEN isodow(d) > 2 THEN isodow(d) - 2 ELSE isodow(d) + 5 END::INT))::DATE AS tuesday
  FROM o
)
SELECT o_orderkey,
       CASE kind WHEN 0 THEN days || ',' || morrow WHEN 1 THEN weeks || ',' || morrow WHEN 2 THEN days::VARCHAR WHEN 3 THEN months::VARCHAR WHEN 4 THEN monday || ',2024-02-29'
                 WHEN 5 THEN month || ',' || tuesday WHEN 6 THEN years::VARCHAR ELSE year || ',' || d END AS iso_dates,
       CASE kind WHEN 0 THEN 'en,en' WHEN 1 THEN 'fr,fr' WHEN 2 THEN 'ar' WHEN 3 THEN 'en' WHEN 4 THEN 'en,fr' WHEN 5 THEN 'fr,fr' WHEN 6 THEN 'en' ELSE 'en,en' END AS languages,
       CASE WHEN kind IN (2, 3, 4, 6) THEN 1 ELSE 2 END::BIGINT AS n_relative,
       CASE kind WHEN 0 THEN 'Due ' || days || ', call ' || morrow || '.' WHEN 1 THEN 'Payé ' || weeks || ', livré ' || morrow || ' 10:00:00' WHEN 2 THEN days::VARCHAR
                 WHEN 3 THEN 'Sent ' || months WHEN 4 THEN monday || ', or on 2024-02-29 not ' || n WHEN 5 THEN month || ', ' || tuesday
                 WHEN 6 THEN years || ' 17:30:00' ELSE year || ' and ' || d END AS normalized_text
FROM t""",
    "pii_emails": f"""
SELECT v AS value, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents) GROUP BY v""",
    "pii_ipv4": f"""
WITH {_IPS}
SELECT doc_id, count(*) AS n, min(v) AS first_ip FROM ips
WHERE len(list_filter(string_split(v, '.'), lambda o: o::INT > 255 OR (length(o) > 1 AND o[1] = '0'))) = 0 GROUP BY doc_id""",
    "pii_email_offsets": f"""
WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents),
s AS (SELECT doc_id, m[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
      FROM p, unnest(range(1, len(m) + 1)) AS t(i))
SELECT doc_id, start, (start + length(value))::INT AS "end", value FROM s""",
    "mask_emails": f"""
WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)
SELECT doc_id, len(m) AS total_masked,
       md5(array_to_string(list_transform(p, lambda x, i: x || coalesce(repeat('#', length(m[i])), '')), '')) AS masked_md5 FROM p""",
    "regex_extract_fields": f"WITH {_RULES} SELECT doc_id, category, name, value, CASE WHEN found THEN sure ELSE 0.0 END::DOUBLE AS confidence, coalesce(found, false) AS found, required FROM judged",
    "regex_extract_stats": f"""
WITH {_RULES}
SELECT doc_id, 3::BIGINT AS total_patterns, count(*) FILTER (WHERE found) AS matched, 3 - count(*) FILTER (WHERE found) AS unmatched,
       round(count(*) FILTER (WHERE found) / 3, 4) AS match_rate, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE required AND NOT found), '') AS missing
FROM judged GROUP BY doc_id""",
    "gap_score": f"""
WITH {_GAPS}, s AS (
  SELECT doc_id, count(*) AS total_fields, count(*) FILTER (WHERE status = 'MATCHED') AS matched,
         count(*) FILTER (WHERE status = 'GAP' AND severity = 'CRITICAL') AS missing_critical,
         count(*) FILTER (WHERE status = 'GAP' AND severity <> 'CRITICAL') AS missing_warning,
         coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE status = 'GAP' AND severity = 'CRITICAL'), '') AS missing
  FROM fields GROUP BY doc_id)
SELECT *, round(matched * 100 / total_fields, 1) AS percentage, round(matched * 100 / total_fields, 1) / 100 >= 0.4 AS threshold_exceeded FROM s""",
    "span_box_union": rf"""
WITH {_EMAIL_SPANS}, lines AS (
  SELECT doc_id, i - 1 AS line, l[i] AS x, (coalesce(list_sum(list_transform(l[1:i - 1], lambda y: length(y))), 0) + i - 1)::INT AS o
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents SEMI JOIN spans USING (doc_id)), unnest(range(1, len(l) + 1)) AS t(i)
), cut AS (
  SELECT doc_id, line, o, regexp_split_to_array(x, '[^ \t\n\x0B\f\r]+') AS p, regexp_extract_all(x, '[^ \t\n\x0B\f\r]+') AS m FROM lines
), words AS (
  SELECT doc_id, line, o, length(m[i]) AS n,
         list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS col
  FROM cut, unnest(range(1, len(m) + 1)) AS t(i)
)
SELECT doc_id, line::INT AS line, min(6.0 * col)::DOUBLE - 0.8 AS x0, min(12.0 * line)::DOUBLE - 0.4 AS y0, max(6.0 * (col + n))::DOUBLE + 0.8 AS x1,
       max(12.0 * line + 10)::DOUBLE + 0.4 AS y1, count(DISTINCT o + col) AS words
FROM spans JOIN words USING (doc_id) WHERE o + col < e + 40 AND s - 40 < o + col + n GROUP BY doc_id, line""",
    "chunks_without_emails": f"""
WITH {_CHUNKS}, {_EMAIL_SPANS}
SELECT doc_id, count(*) AS chunks, sum(char_end - char_start)::BIGINT AS chars
FROM chunks AS c WHERE NOT EXISTS (SELECT 1 FROM spans AS s WHERE s.doc_id = c.doc_id AND s.s < c.char_end AND c.char_start < s.e) GROUP BY doc_id""",
    "gap_missing": f"WITH {_GAPS} SELECT doc_id, field, severity FROM fields WHERE status = 'GAP'",
    "clean_stats": f"""
WITH d AS (SELECT lang, {_DIRTY} AS text FROM documents), c AS (SELECT lang, length(text) AS n, length({_clean('text')}) AS m FROM d)
SELECT lang, count(*) AS docs, sum(n)::BIGINT AS original, sum(m)::BIGINT AS cleaned, max(n - m) AS most_removed FROM c GROUP BY lang""",
    "spell_merge": """
WITH t AS (SELECT n_nationkey, lower(n_name) AS n FROM nation)
SELECT n_nationkey, CASE WHEN contains(n, ' ') THEN 'from ' || n[1:3] || ' ' || n[4:] || ' to x' ELSE 'from ' || n || ' to x' END AS corrected_text,
       CASE WHEN contains(n, ' ') THEN 0 ELSE 1 END AS n_changes FROM t""",
    "spell_documents": r"""
WITH planted AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, ' ([a-z]{4})([a-z])([a-z]{4}) ', ' \1\2\2\3 ', 'g'), ' ([a-z]{4})([a-z]{6}) ', ' \1 \2 ', 'g') AS text FROM documents
), dict AS MATERIALIZED (
  SELECT lower(w) AS term, count(*) AS f FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 5
), words AS MATERIALIZED (
  SELECT doc_id, i, m[i] AS w, p[i] AS gap FROM (
    SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS m, regexp_split_to_array(text, '[A-Za-zÀ-ÿ]+') AS p FROM planted), unnest(range(1, len(p) + 1)) AS t(i)
), wrong AS MATERIALIZED (
  SELECT DISTINCT w, lower(w) AS l FROM words WHERE w IS NOT NULL AND NOT (w = upper(w) AND length(w) <= 4) AND lower(w) NOT IN (SELECT term FROM dict)
), keys AS (
  SELECT term, f, i, CASE WHEN i = 0 THEN term ELSE term[:i - 1] || term[i + 1:] END AS k FROM dict, unnest(range(0, length(term) + 1)) AS t(i)
), asked AS (
  SELECT w, i, CASE WHEN i = 0 THEN l ELSE l[:i - 1] || l[i + 1:] END AS k FROM wrong, unnest(range(0, length(l) + 1)) AS t(i)
), near AS (
  SELECT DISTINCT w, term, f FROM asked a JOIN keys b USING (k) WHERE a.i = 0 OR b.i = 0 OR a.i = b.i
), best AS (
  SELECT w, CASE WHEN w = upper(w) AND length(w) > 1 THEN upper(t) WHEN w[1] = upper(w[1]) THEN upper(t[1]) || t[2:] ELSE t END AS c
  FROM (SELECT w, first(term ORDER BY f DESC, term) AS t FROM near GROUP BY w)
), fixed AS MATERIALIZED (
  SELECT doc_id, string_agg(gap || coalesce(c, w, ''), '' ORDER BY i) AS text, count(c) FILTER (WHERE c <> w) AS n_corrections
  FROM words LEFT JOIN best USING (w) GROUP BY doc_id
), tokens AS MATERIALIZED (
  SELECT doc_id, i, m[i] AS a, m[i + 1] AS b FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS m FROM fixed), unnest(range(1, len(m) + 1)) AS t(i)
), pairs AS (
  SELECT doc_id, i FROM tokens WHERE lower(a) || lower(b) IN (SELECT term FROM dict) AND NOT (lower(a) IN (SELECT term FROM dict) AND lower(b) IN (SELECT term FROM dict))
), runs AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM pairs
), taken AS (
  SELECT doc_id, i FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY i) % 2 = 1
), merged AS (
  SELECT doc_id, string_agg(a || CASE WHEN x.i IS NOT NULL OR b IS NULL THEN '' ELSE ' ' END, '' ORDER BY t.i) AS text, count(x.i) AS n
  FROM tokens t LEFT JOIN taken x USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n_corrections::INT AS n_corrections, coalesce(n, 0)::INT AS n_merges, md5(CASE WHEN n > 0 THEN merged.text ELSE fixed.text END) AS corrected_md5
FROM fixed LEFT JOIN merged USING (doc_id)""",
    "gap_report": f"WITH {_GAPS} SELECT field, severity, status, method, count(*) AS n FROM fields GROUP BY ALL",
    "gap_invoices": """
WITH s AS (SELECT 2 + (o_orderstatus <> 'F')::BIGINT AS matched FROM orders)
SELECT round(matched * 100 / 6, 1) AS percentage, matched, 4 - matched AS missing_critical, 2::BIGINT AS missing_warning, count(*) AS n FROM s GROUP BY matched""",
    "language_rank": f"WITH {_languages('document')} SELECT doc_id, lang, probability, rank FROM detected",
    "language_model_rank": f"""
WITH {_MODEL}
SELECT doc_id, lang, probability, rank FROM ranked WHERE rank <= 5
UNION ALL SELECT doc_id, 'unknown', 0.0, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ranked)""",
    "language_segments": f"WITH {_languages('paragraph')} SELECT d.lang, x.lang AS found, count(*) AS n FROM detected x JOIN documents d USING (doc_id) WHERE rank = 1 GROUP BY ALL",
    "claim_split": rf"""
WITH c AS (SELECT conv_id, turn, {_strip('c')} AS c FROM (
  SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS c FROM conversations))
SELECT conv_id, turn, count(*) AS claims, sum(length(c))::BIGINT AS chars FROM c WHERE length(c) > 5 GROUP BY ALL""",
    "line_overlap": rf"""
WITH l AS (SELECT doc_id, replace(lower({_strip("regexp_replace(x, '\\s+', ' ', 'g')")}), 'ß', 'ss') AS u, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY ALL),
r AS (SELECT doc_id, replace(lower({_strip("regexp_replace(x, '\\s+', ' ', 'g')")}), 'ß', 'ss') AS u, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(upper(text), '.', ';'), chr(10))) AS x FROM documents) GROUP BY ALL)
SELECT doc_id, sum(least(coalesce(l.n, 0), coalesce(r.n, 0)))::BIGINT AS common, sum(greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0))::BIGINT AS only_left,
       sum(greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0))::BIGINT AS only_right
FROM l FULL JOIN r USING (doc_id, u) GROUP BY doc_id""",
    "spell_corrections": """
WITH w AS (SELECT upper(n_name[1]) || lower(n_name[2:]) || 'x' AS word FROM nation), t AS (SELECT DISTINCT lower(n_name) AS term FROM nation),
p AS (SELECT word, term, levenshtein(lower(word), term) AS d FROM w, t WHERE lower(word) NOT IN (SELECT term FROM t)),
b AS (SELECT word, min(struct_pack(d := d, term := term)) AS b FROM p WHERE d <= 1 GROUP BY word)
SELECT word, upper(b.term[1]) || b.term[2:] AS corrected, b.d::INT AS distance FROM b""",
    "edit_distance": "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part",
    "llm_json_recovery": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'none' ELSE role END AS found_role, CASE WHEN turn % 3 = 2 THEN -1 ELSE turn END AS found_turn FROM conversations""",
    "typed_extract": r"""
WITH k AS (
  SELECT conv_id, turn, role, length(text) AS n, substr(text, 1, 40) AS said, (conv_id + turn) % 5 AS kind FROM conversations
), replies AS (
  SELECT conv_id, turn, '{"role": "' || role || '", "size": ' || CASE kind WHEN 0 THEN n::VARCHAR WHEN 1 THEN '"' || n || '.5"' WHEN 2 THEN '"some"' WHEN 3 THEN 'null' ELSE '[1]' END
         || ', "words": ' || CASE kind WHEN 1 THEN '"one two"' WHEN 2 THEN '[]' WHEN 3 THEN '{"a": 1}' ELSE '[' || n || ', "x"]' END
         || ', "said": ' || to_json([said])::VARCHAR || CASE WHEN n % 7 = 6 THEN '' ELSE '}' END AS reply FROM k
), docs AS (
  SELECT conv_id, turn, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM replies
), got AS (
  SELECT conv_id, turn, j ->> '$.role' AS role, json_type(j, '$.size') AS size_type, j ->> '$.size' AS size, json_type(j, '$.words') AS words_type,
         (j -> '$.said')::VARCHAR AS said FROM docs
), judged AS (
  SELECT *, coalesce(size_type, 'NULL') <> 'NULL' AS has_size, TRY_CAST(size AS DOUBLE) AS number, (role IS NOT NULL)::INT + (coalesce(size_type, 'NULL') <> 'NULL')::INT
         + (coalesce(words_type, 'NULL') <> 'NULL')::INT + (said IS NOT NULL)::INT AS matched FROM got
)
SELECT conv_id, turn, role, CASE WHEN size_type <> 'ARRAY' THEN number END AS size,
       CASE WHEN NOT has_size THEN 0.0 WHEN size_type = 'ARRAY' OR number IS NULL THEN 0.3 ELSE 0.9 END::DOUBLE AS size_confidence,
       CASE WHEN words_type IS NULL THEN 0.0 WHEN words_type = 'ARRAY' THEN 0.9 ELSE 0.2 END::DOUBLE AS words_confidence,
       md5(said) AS said_md5, matched, round(matched / 4, 4) AS match_rate FROM judged""",
    "answer_parse": "SELECT conv_id, turn, role AS answer, CASE WHEN conv_id % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM conversations",
    "translate_identity": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "sentiment_defaults": "SELECT doc_id, 'neutral' AS polarity, 0.0::DOUBLE AS score, 0.0::DOUBLE AS confidence, '' AS summary FROM documents",
    "semantic_extract": "SELECT doc_id, (42 + length(text))::VARCHAR AS size, 0.9::DOUBLE AS confidence, false AS found FROM documents",
    "ocr_line_aggregate": r"""
WITH k AS (SELECT conv_id, turn, text, (turn % 7) / 10 AS c FROM conversations WHERE regexp_matches(text, '\S'))
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text, count(*) AS total_lines, round(avg(c), 4) AS avg_confidence,
       (sum(length(text)) + count(*) - 1)::BIGINT AS total_chars FROM k GROUP BY conv_id""",
    "element_type_summary": r"""
SELECT CASE role WHEN 'user' THEN 'Title' WHEN 'assistant' THEN 'Table' ELSE 'Text' END AS element_type, count(*) AS elements,
       sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY 1""",
}
