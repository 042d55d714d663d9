"""SQL of queries whose operator module holds none: slow, and for comparison alone."""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b
), k AS (
  SELECT node, min(c) AS c FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.node = d.doc_id
"""

#: Texts as hexadecimal digits, two a byte.
SUFFIX_DEDUP = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b)
), m AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS opens FROM w JOIN m USING (s) WHERE m < doc_id
), g AS (
  SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c
), sp AS (
  SELECT doc_id, k, min(i) AS s, max(i) + 50 AS e FROM g GROUP BY ALL
), sums AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM sp GROUP BY doc_id
), kept AS (
  SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k: substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END) + 1, 2 * ((CASE WHEN k = n_spans + 1 THEN length(h) // 2 ELSE ss[k] END) - (CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END)))), '') END AS h
  FROM b LEFT JOIN sums USING (doc_id)
)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""
