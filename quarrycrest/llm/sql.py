"""SQL that computes the same results in another way, where SQL can."""

from __future__ import annotations

_PAGE = r"""
  'https://' || regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '')
  || coalesce(nullif(regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN regexp_extract(url, '(\?[^#]*)', 1) ELSE '' END
"""

_REPEATED = rf"""
WITH rows AS (
  SELECT rec_id, text, {_PAGE} AS page,
         regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS site
  FROM academic_info WHERE url IS NOT NULL AND text <> ''),
sizes AS (SELECT site, count(DISTINCT page) AS n FROM rows GROUP BY site),
lines AS (
  SELECT rec_id, page, site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM rows),
keyed AS (SELECT *, lower(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) AS k FROM lines),
often AS (
  SELECT site, k FROM keyed JOIN sizes USING (site) WHERE k <> ''
  GROUP BY site, k, n HAVING count(DISTINCT page) >= 5 AND count(DISTINCT page) * 5 >= n)
"""

ORACLES = {
    "p3_found": """
SELECT a.rec_id FROM academic_info a
JOIN chunk_policy p ON p.content_type = coalesce(a.content_type, '')
WHERE length(trim(a.text, ' ' || chr(9) || chr(10) || chr(13))) > p.max_chars
""",
    "p4_found": f"{_REPEATED} SELECT rec_id, line_no FROM keyed JOIN often USING (site, k)",
    "p4_texts": f"""{_REPEATED}
, gone AS (SELECT rec_id, line_no FROM keyed JOIN often USING (site, k)),
kept AS (
  SELECT rec_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE (rec_id, line_no) NOT IN (SELECT rec_id, line_no FROM gone)) AS text
  FROM keyed GROUP BY rec_id),
counts AS (SELECT rec_id, count(*) AS removed FROM gone GROUP BY rec_id)
SELECT a.rec_id, CASE WHEN removed IS NULL THEN a.text ELSE coalesce(kept.text, '') END AS text, coalesce(removed, 0) AS removed
FROM academic_info a LEFT JOIN counts USING (rec_id) LEFT JOIN kept USING (rec_id)
""",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    # every pair that shares a sequence is compared
    "p1_found": r"""
WITH words AS (SELECT rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM gap_fill_data),
sequences AS (SELECT DISTINCT rec_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rec_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
sizes AS (SELECT rec_id, count(*) AS n FROM sequences GROUP BY rec_id),
shared AS (
  SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS i FROM sequences a JOIN sequences b ON a.s = b.s AND a.rec_id < b.rec_id GROUP BY ALL)
SELECT rec_a, rec_b FROM shared JOIN sizes x ON x.rec_id = rec_a JOIN sizes y ON y.rec_id = rec_b WHERE i * 10 >= (x.n + y.n - i) * 6
""",
}
