"""DuckDB statements that define the results of the operators SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1
    THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
root AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, root.component_id, w.doc_id = root.component_id AS kept
FROM w JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)
"""

CONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    array_to_string(ws[k : k + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT r.doc_id, r.k, r.n, win.item_id FROM runs r JOIN win ON win.n = r.n AND win.w = r.w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

SHARDED = """
SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, true AS within_target FROM documents
"""

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''),
    '[\x09-\x0D\x20]*(?:[^.!?\n]|[.!?]+[^.!?\x09-\x0D\x20])*(?:[.!?]+[\x09-\x0D\x20]*|\n[\x09-\x0D\x20]*|$)'), lambda x: len(x) > 0) AS ss
  FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(ss) + 1)) AS k, unnest(ss) AS raw FROM d),
f AS (
  SELECT doc_id, k, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x09-\x0D\x20]+', ' ', 'g')) AS form FROM s),
w AS (SELECT *, CASE WHEN form = '' THEN 0 ELSE len(string_split(form, ' ')) END AS n FROM f),
c AS (SELECT doc_id, k, n, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w),
place AS (
  SELECT a.doc_id, a.k, min(b.k) - a.k + 1 AS size FROM c a JOIN c b
  ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + 1 AND a.k + 11 AND b.upto - a.upto + a.n >= 12 GROUP BY a.doc_id, a.k
  UNION SELECT a.doc_id, max(b.k), a.k - max(b.k) + 1 FROM c a JOIN c b
  ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 11 AND a.k - 1 AND a.upto - b.upto + b.n >= 12 GROUP BY a.doc_id, a.k
  UNION SELECT doc_id, k, 1 FROM c WHERE n >= 25),
forms AS (SELECT doc_id, list(form ORDER BY k) AS fs FROM w GROUP BY doc_id),
span AS (
  SELECT p.doc_id, p.k, p.size, array_to_string(fs[p.k : p.k + p.size - 1], chr(10)) AS joint
  FROM place p JOIN forms USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY joint ORDER BY doc_id, k) AS nth FROM span),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM ranked WHERE nth > 1),
marked AS (
  SELECT w.doc_id, w.k, w.raw, len(w.raw) AS size, gone.k IS NOT NULL AS out,
    sum(len(w.raw)) OVER (PARTITION BY w.doc_id ORDER BY w.k) - len(w.raw) AS a
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.k = w.k),
kept AS (
  SELECT doc_id, string_agg(raw, '' ORDER BY k) FILTER (WHERE NOT out) AS text, count(*) AS n_sentences, count(*) FILTER (WHERE out) AS n_removed
  FROM marked GROUP BY doc_id),
runs AS (SELECT doc_id, k, a, size, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM marked WHERE out),
ranges AS (SELECT doc_id, CAST(min(a) AS BIGINT) AS x, CAST(max(a + size) AS BIGINT) AS y FROM runs GROUP BY doc_id, g),
listed AS (SELECT doc_id, string_agg(x || ':' || y, ',' ORDER BY x) AS removed FROM ranges GROUP BY doc_id)
SELECT d.doc_id, coalesce(kept.text, '') AS text, len(coalesce(kept.text, '')) AS n_chars, coalesce(n_sentences, 0) AS n_sentences,
  coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
