"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

from loomery.llm import linededup

OP4 = r"""
WITH split_urls AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(verdict, h, p)),
best AS (
  SELECT s.page_id, s.url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split_urls s JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)
  GROUP BY s.page_id, s.url)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM split_urls s LEFT JOIN best b ON s.page_id = b.page_id AND s.url = b.url
"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, text, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
long AS (SELECT * FROM lines WHERE len(regexp_split_to_array(line, ' +')) >= {linededup.MIN_WORDS}),
boiler AS (
  SELECT line, min(doc_id) AS first_id FROM long GROUP BY line HAVING count(DISTINCT source) >= {linededup.MIN_SITES}),
cut_up AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS n
  FROM documents WHERE text IS NOT NULL),
kept AS (
  SELECT c.doc_id, c.text, count(*) AS n_lines, count(b.line) AS n_removed,
         coalesce(string_agg(c.part, chr(10) ORDER BY c.n) FILTER (WHERE b.line IS NULL), '') AS rest
  FROM cut_up c LEFT JOIN boiler b ON trim(c.part) = b.line AND c.doc_id <> b.first_id
  GROUP BY c.doc_id, c.text)
SELECT doc_id, n_lines, n_removed, md5(rest) AS text_md5 FROM kept
UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
"""
