"""DuckDB twins of the training-data operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{pattern}')"


DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
item AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM item WHERE len(w) > 0) t),
place AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM doc, (SELECT DISTINCT size FROM win) z WHERE len(w) >= size) t),
hit AS (SELECT DISTINCT p.doc_id, p.k, p.size, w.item_id FROM place p JOIN win w ON p.size = w.size AND p.s = w.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS k FROM hit) t GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id"""

JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words('text', _SOLID)} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc WHERE len(w) > 0) t),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT x.a, x.b
  FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM shingle s JOIN shingle t ON s.s = t.s AND s.doc_id <> t.doc_id
        GROUP BY s.doc_id, t.doc_id) x
  JOIN size p ON p.doc_id = x.a JOIN size q ON q.doc_id = x.b
  WHERE 100 * x.c >= 75 * (p.n + q.n - x.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM doc d LEFT JOIN size s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""

SUFFIX_DEDUP = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
start AS (
  SELECT doc_id, k, md5(substr(x, 2 * k + 1, 400)) AS s
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS k FROM doc WHERE len(x) >= 400) t),
twice AS (
  SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before
  FROM start SEMI JOIN (SELECT s FROM start GROUP BY s HAVING count(*) > 1) d ON start.s = d.s),
span AS (
  SELECT doc_id, min(k) AS lo, max(k) + 200 AS hi
  FROM (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 200 THEN 1 ELSE 0 END)
                            OVER (PARTITION BY doc_id ORDER BY k) AS run FROM twice) t
  GROUP BY doc_id, run),
gap AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM span
  UNION ALL SELECT s.doc_id, max(s.hi), max(len(d.x)) // 2 FROM span s JOIN doc d ON d.doc_id = s.doc_id GROUP BY s.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(d.x, 2 * g.lo + 1, 2 * (g.hi - g.lo)), '' ORDER BY g.lo, g.hi) AS x
         FROM gap g JOIN doc d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
cut AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM doc d LEFT JOIN cut c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""

LEXICAL_SEARCH = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
term AS (SELECT r, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
         FROM (SELECT r, doc_id, unnest(w) AS t FROM doc) u),
size AS (SELECT r, count(*) AS n FROM term GROUP BY r),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM size),
tf AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM term GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
           FROM tf, whole GROUP BY t),
item AS (
  SELECT DISTINCT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark WHERE item_id IS NOT NULL) u),
score AS (
  SELECT i.item_id, f.r, f.doc_id,
         CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * s.n * z.n_docs) // z.n_all)))) AS BIGINT) AS score
  FROM item i JOIN tf f ON f.t = i.t JOIN weight w ON w.t = i.t JOIN size s ON s.r = f.r, whole z
  GROUP BY i.item_id, f.r, f.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM score WHERE score > 0) t
WHERE rank <= 50"""

EXACT_TOPK = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) t
WHERE rank <= 5"""
