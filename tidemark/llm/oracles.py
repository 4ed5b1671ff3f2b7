"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

_OP7 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS after FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max({'rule': r_host || r_path, 'verdict': r_verdict}, length(r_host) * 100000 + length(r_path)) AS best
  FROM split JOIN rules ON (host = r_host OR suffix(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id
)
SELECT s.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""

_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (
  SELECT x AS u, y AS v FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(v) FROM reach r WHERE r.u = doc_id), doc_id)) AS component_id FROM sets
"""

ORACLES = {"op7_url_filter": _OP7, "op10_ngram_join": _OP10}
