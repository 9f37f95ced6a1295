"""SQL for DuckDB of the operators' queries that SQL can express: small tables only, as it compares what the operators avoid to."""

from __future__ import annotations

#: What is left of a piece's bytes, in hexadecimal, without characters that were cut in part.
_WHOLE = "regexp_replace(regexp_replace({}, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){{0,2}})$', '')"

SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, encode(COALESCE(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM d, UNNEST(range(1, octet_length(b) - 398)) t(i)),
repeated AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING COUNT(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i - LAG(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated),
numbered AS (SELECT r, i, SUM(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
spans AS (SELECT r, MIN(i) AS a, MAX(i) + 400 AS e FROM numbered GROUP BY r, g),
removed AS (SELECT r, CAST(SUM(e - a) AS BIGINT) AS n_removed, COUNT(*) AS n_spans, MAX(e) AS last FROM spans GROUP BY r),
pieces AS (SELECT r, LAG(e, 1, 1) OVER (PARTITION BY r ORDER BY a) AS s, a AS t FROM spans
    UNION ALL SELECT r, last, octet_length(b) + 1 FROM removed JOIN d USING (r)),
kept AS (SELECT r, string_agg(x, '' ORDER BY s) AS raw, string_agg(decode(unhex({_WHOLE.format('x')})), '' ORDER BY s) AS left_
    FROM (SELECT r, s, CASE WHEN t > s THEN hex(b[s:t - 1]) ELSE '' END AS x FROM pieces JOIN d USING (r)) p GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(raw)) END AS kept_sha256, CASE WHEN n_spans IS NULL THEN text ELSE left_ END AS text
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

CHOSEN_PATH = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS x FROM d, UNNEST(range(1, GREATEST(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) t(i)),
n AS (SELECT r, COUNT(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, COUNT(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(r, t) AS (SELECT r, r FROM n UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT reach.r, MIN(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.t GROUP BY reach.r)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(component_id, d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM COALESCE(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN least ON least.r = d.r
"""

WARC = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
g AS (SELECT payload, MAX(page_id) AS largest, sha1(payload) AS hex FROM p GROUP BY payload),
b AS (SELECT payload, largest, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1)::INTEGER, 1)), '') AS digest FROM g)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p JOIN b USING (payload)
"""
