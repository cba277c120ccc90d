"""DuckDB SQL of the queries that SQL can express, by the name of the query."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

op10_warc = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
v AS (SELECT page_id, payload_bytes, hex,
  list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5))::BIGINT) AS q,
  min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(q, lambda x: substr('{_BASE32}', CAST((x >> 15) & 31 AS INT) + 1, 1) || substr('{_BASE32}', CAST((x >> 10) & 31 AS INT) + 1, 1)
    || substr('{_BASE32}', CAST((x >> 5) & 31 AS INT) + 1, 1) || substr('{_BASE32}', CAST(x & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""

op3_line_frequency = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT rid, source, md5(text) AS body, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT rid, source, text, unnest(ls) AS l FROM w)),
spoken AS (SELECT * FROM lines WHERE line <> ''),
counts AS (SELECT source, line, count(DISTINCT body) AS n FROM spoken GROUP BY source, line),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS docs FROM d GROUP BY source),
frequent AS (SELECT c.source, c.line FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n > 20 AND c.n > 0.01 * h.docs),
removed AS (SELECT s.rid, sum(len(string_split(s.line, ' '))) AS gone FROM spoken s JOIN frequent f ON s.source IS NOT DISTINCT FROM f.source AND s.line = f.line GROUP BY s.rid),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(i - before, 8))) AS n_rep FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
base AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN removed r ON r.rid = w.rid),
flag AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND NOT (n_words - removed_words < 0.3 * n_words) AS kept FROM flag
"""

op7_line_dedup = r"""
WITH l AS (SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, unnest(range(len(ls))) AS place, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, place, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
s AS (SELECT doc_id, place, norm FROM w WHERE norm <> ''),
f AS (SELECT norm, len(string_split(norm, ' ')) AS words, min({'d': doc_id, 'p': place}) AS first FROM s GROUP BY norm),
u AS (SELECT norm, first, 'word' AS kind, words >= 8 AS emits, list_transform(string_split(norm, ' '), lambda x: hash(x)) AS units FROM f WHERE words >= 7
  UNION ALL SELECT norm, first, 'letter', true, list_transform(range(1, length(norm) + 1), lambda i: hash(substr(norm, CAST(i AS INT), 1))) FROM f WHERE words <= 7),
v AS (SELECT norm, first, kind, len(units) AS n, i, list_concat(units[1:i - 1], units[i + 1:]) AS v
  FROM (SELECT *, unnest(range(1, len(units) + 1)) AS i FROM u WHERE emits)),
h AS (SELECT norm, first, kind, n, i, md5(CAST(v AS VARCHAR)) AS v FROM v),
m AS (SELECT norm, first, min(first) OVER (PARTITION BY kind, v, i, n) AS earliest FROM h),
e AS (SELECT norm, first, kind, md5(CAST(units AS VARCHAR)) AS v FROM u),
near AS (SELECT DISTINCT norm FROM (
  SELECT norm FROM m WHERE earliest < first
  UNION ALL SELECT h.norm FROM h JOIN e ON e.kind = h.kind AND e.v = h.v WHERE e.first < h.first
  UNION ALL SELECT e.norm FROM h JOIN e ON e.kind = h.kind AND e.v = h.v WHERE h.first < e.first)),
gone AS (SELECT s.doc_id, s.place, (n2.norm IS NOT NULL AND f.first = {'d': s.doc_id, 'p': s.place}) AS near
  FROM s JOIN f ON s.norm = f.norm LEFT JOIN near n2 ON n2.norm = s.norm
  WHERE n2.norm IS NOT NULL OR f.first <> {'d': s.doc_id, 'p': s.place}),
agg AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE near) AS n_near, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""
