"""DuckDB SQL of corpus queries whose text is long."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, byte by byte and bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
         CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AND text IS NOT NULL
              THEN {leaf("replace(text, chr(10), '')")} END AS altered
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
s AS (
  SELECT source, 0 AS lvl, idx, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM r
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3
  FROM s WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
top AS (SELECT source, node AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM s WHERE n = 1),
a AS (
  SELECT 0 AS lvl, place AS idx, subroot AS node, count(*) OVER () AS n FROM top
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY lvl, idx // 3, n),
-- the runs of both trees: digests in order, by level above the source's leaves
runs AS (
  SELECT source, lvl, idx // 3 AS run, list(node ORDER BY idx) AS nodes FROM s WHERE n > 1 GROUP BY source, lvl, idx // 3),
above AS (SELECT lvl, idx // 3 AS run, list(node ORDER BY idx) AS nodes FROM a WHERE n > 1 GROUP BY lvl, idx // 3),
walk AS (
  SELECT r.doc_id, r.source, r.leaf, r.idx AS leaf_idx, top.subroot, top.height, top.place, 0 AS lvl, r.idx AS idx,
         coalesce(r.altered, r.leaf) AS folded, '' AS proof
  FROM r JOIN top ON r.source IS NOT DISTINCT FROM top.source
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.leaf_idx, w.subroot, w.height, w.place, w.lvl + 1,
         CASE WHEN w.lvl + 1 = w.height THEN w.place ELSE w.idx // 3 END,
         sha256(list_aggregate(list_transform(runs.nodes, lambda x, i: CASE WHEN i = w.idx % 3 + 1 THEN w.folded ELSE x END), 'string_agg', '')),
         w.proof || coalesce(list_aggregate(list_transform(runs.nodes, lambda x, i: CASE WHEN i = w.idx % 3 + 1 THEN '' ELSE x END), 'string_agg', ''), '')
  FROM walk w JOIN runs ON w.lvl < w.height AND w.source IS NOT DISTINCT FROM runs.source AND w.lvl = runs.lvl AND w.idx // 3 = runs.run),
up AS (
  SELECT doc_id, source, leaf, leaf_idx, subroot, 0 AS lvl, place AS idx, folded, proof FROM walk WHERE lvl = height
  UNION ALL
  SELECT u.doc_id, u.source, u.leaf, u.leaf_idx, u.subroot, u.lvl + 1, u.idx // 3,
         sha256(list_aggregate(list_transform(above.nodes, lambda x, i: CASE WHEN i = u.idx % 3 + 1 THEN u.folded ELSE x END), 'string_agg', '')),
         u.proof || coalesce(list_aggregate(list_transform(above.nodes, lambda x, i: CASE WHEN i = u.idx % 3 + 1 THEN '' ELSE x END), 'string_agg', ''), '')
  FROM up u JOIN above ON u.lvl = above.lvl AND u.idx // 3 = above.run)
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.node AS verified
FROM up, (SELECT node, lvl FROM a WHERE n = 1) AS root WHERE up.lvl = root.lvl
"""

_TURN = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"

TRIE = f"""
WITH t AS (
  SELECT conv_id, {_TURN} AS turn_key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, ({crc32("CAST(conv_id AS VARCHAR)")}) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, turn_key, words FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, turn_key, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
s AS (
  SELECT c.conv_id, coalesce(list(turn_key ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS keys, list(words ORDER BY part, pos) AS words
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, unnest(range(0, len(keys) + 1)) AS depth, keys, words FROM s),
n AS (
  SELECT keys[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(keys) = depth), '') AS ends
  FROM p GROUP BY keys[1:depth], depth),
up AS (
  SELECT n.*, parent.conv_id AS parent_conv_id, parent.path AS parent_path
  FROM n LEFT JOIN n AS parent ON n.depth = parent.depth + 1 AND n.path[1:parent.depth] = parent.path),
kids AS (SELECT parent_path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY parent_path),
full_n AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON up.path = kids.parent_path),
below AS (
  SELECT v.path, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM full_n v JOIN full_n u ON u.depth >= v.depth AND u.path[1:v.depth] = v.path GROUP BY v.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_n JOIN below USING (path)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM (SELECT * FROM v WHERE usable) a JOIN (SELECT * FROM v WHERE usable) b
    ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT rid, rid AS other FROM v UNION SELECT reach.rid, links.b FROM reach JOIN links ON reach.other = links.a),
groups AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.other GROUP BY reach.rid)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.rid) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN groups USING (rid)
"""
