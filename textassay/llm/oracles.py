"""DuckDB SQL for the numbered queries that SQL can express."""

OP6 = r"""
WITH low AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
         row_number() OVER (ORDER BY doc_id) AS rid
  FROM documents),
dw AS (
  SELECT rid, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM iw, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT d.rid, d.p, d.k, win.item_id
  FROM (SELECT rid, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
        FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)) d
  JOIN win USING (k, g)),
hit AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + k)) AS q FROM occ) GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256,
       hit.n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""
