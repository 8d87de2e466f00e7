"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import BARS, BOILERPLATE, SYMBOLS, TERMINAL

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""

_quoted = ", ".join("'" + c.replace("'", "''") + "'" for c in TERMINAL)

OP7 = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(CASE WHEN nxt IS NULL THEN 8 ELSE least(8, nxt - i) END) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, l, regexp_extract_all(l, '{WORD}') AS w, right(rtrim(l, {BLANKS} || chr(160)), 1) IN ({_quoted}) AS ended, length(translate(l, {BLANKS}, '')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
worded AS (SELECT *, length(l) AS n FROM l WHERE chars > 0),
judged AS (SELECT doc_id, l, chars, (n - length(translate(l, '{SYMBOLS}', ''))) * 100 > n * 10 OR n - length(translate(l, '{BARS}', '')) >= 3 OR (NOT ended AND n < 200 AND regexp_matches(l, '{BOILERPLATE}'))
  OR (len(w) < 3 AND NOT ended) OR (NOT ended AND len(w) >= 3 AND len(list_filter(w, lambda x: lower(left(x, 1)) = left(x, 1))) = 0) OR (len(w) >= 10 AND len(list_distinct(w)) * 4 < len(w)) AS fails FROM worded),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, COALESCE(CAST(sum(chars) FILTER (WHERE NOT fails) AS BIGINT), 0) AS clean_chars FROM judged GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {BLANKS}, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(cov.n, 0) AS n_repeat_words, COALESCE(clean_chars, 0) AS clean_chars FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * clean_chars >= 50 * word_chars AS kept FROM b
"""

OP9 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hx, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hx, CAST((k // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
