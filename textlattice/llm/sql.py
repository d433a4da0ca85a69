"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, l.b FROM reach r JOIN two l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
owners AS (SELECT h, min(doc_id) AS o FROM places WHERE h IS NOT NULL GROUP BY h),
hits AS (SELECT doc_id, i, word, coalesce(o < doc_id, false) AS hit FROM places LEFT JOIN owners USING (h)),
flags AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS k FROM flags GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

SUFFIX_DEDUP = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT doc_id, length(x) // 2 AS n, 200 * k AS base, substr(x, 400 * k + 1, 498) AS y FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2 + 199) // 200)) AS k FROM bytes)),
places AS (
  SELECT doc_id, base + j AS i, substr(y, 2 * j - 1, 2) AS b, CASE WHEN base + j + 49 <= n THEN md5(substr(y, 2 * j - 1, 100)) END AS h
  FROM (SELECT *, unnest(range(1, least(200, n - base) + 1)) AS j FROM pieces)
),
owners AS (SELECT h, min(doc_id) AS o FROM places WHERE h IS NOT NULL GROUP BY h),
hits AS (SELECT doc_id, i, b, coalesce(o < doc_id, false) AS hit FROM places LEFT JOIN owners USING (h)),
flags AS (SELECT doc_id, i, b, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
heads AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM flags),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS k FROM heads GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
