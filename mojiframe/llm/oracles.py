"""DuckDB SQL of the queries that SQL can express; that of the URL filter is with it."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Windows of each item against windows of the same length of each document.
DECONTAMINATE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wi AS (
  SELECT DISTINCT item, m, w[p:p + m - 1] AS win
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
wd AS (
  SELECT r, m, p, w[p:p + m - 1] AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM wi) WHERE len(w) >= m)),
h AS (SELECT wd.r, wd.p, wd.m, wi.item FROM wd JOIN wi ON wd.m = wi.m AND wd.win = wi.win),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM h)) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

#: Shared shingles of every two rows, links, and what a row reaches by them.
JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[p:p + 2], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT s.r, s.g, n.n FROM s JOIN n USING (r) JOIN d USING (r) WHERE d.doc_id IS NOT NULL),
l AS (
  SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON a.g = b.g AND a.r <> b.r AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT t.a AS r, min(doc_id) AS low FROM t JOIN d ON t.b = d.r GROUP BY t.a),
f AS (SELECT a AS r, count(*) AS k FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, c.low) AS component_id, CAST(coalesce(f.k, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN f USING (r)
"""
