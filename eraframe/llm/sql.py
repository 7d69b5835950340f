"""DuckDB SQL of the queries that SQL can express, over the same tables."""

LEAKS = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS phrase, least(len(w), 10) AS n
  FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS s)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM phrases), places AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS phrase
  FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 2, 1))) AS s)
), hits AS (
  SELECT doc_id, item, s, places.n FROM places JOIN phrases USING (phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MANIFEST = """
WITH RECURSIVE texts AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN list_reduce(
                list_prepend(4294967295, list_transform(
                  string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda c, b: list_reduce(
                  [xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) % 2 = 1
              THEN replace(text, chr(10), '') ELSE text END AS altered
  FROM documents
), heads AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
            || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
  FROM texts
), leaves AS (
  SELECT doc_id, source,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS other
  FROM heads
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS node FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 3, (any_value(n) + 2) // 3,
         sha256(string_agg(node, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, place // 3
), subroots AS (
  SELECT tree, level AS height, node AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, tree AS place, n, subroot AS node FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, (any_value(n) + 2) // 3,
         sha256(string_agg(node, '' ORDER BY place))
  FROM upper_nodes WHERE n > 1 GROUP BY place // 3
), lower_steps AS (
  SELECT a.tree, a.level, a.place,
         coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.place
), upper_steps AS (
  SELECT a.level, a.place,
         coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY a.level, a.place
), steps AS (
  SELECT p.tree, p.place, s.level, s.l, s.r
  FROM placed p JOIN lower_steps s
    ON s.tree = p.tree AND s.place = p.place // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT p.tree, p.place, t.height + s.level, s.l, s.r
  FROM placed p JOIN subroots t ON t.tree = p.tree
  JOIN upper_steps s ON s.place = p.tree // (3 ** s.level)::BIGINT
), folds AS (
  SELECT tree, place, 0 AS level, other AS node FROM placed
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(s.l || f.node || s.r)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.level = f.level
), ends AS (
  SELECT tree, place, max_by(node, level) AS folded_root FROM folds GROUP BY tree, place
), proofs AS (
  SELECT tree, place, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256
  FROM steps GROUP BY tree, place
), top AS (SELECT node AS root FROM upper_nodes WHERE n = 1)
SELECT p.doc_id, p.leaf, t.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM placed p JOIN subroots t USING (tree) JOIN ends USING (tree, place)
LEFT JOIN proofs USING (tree, place) CROSS JOIN top
"""
