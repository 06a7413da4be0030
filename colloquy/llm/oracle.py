"""The same results in DuckDB's SQL, where it can express them on whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS turn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)
), o AS (
  SELECT *, CASE WHEN level * w < cap THEN level END AS open FROM l
), g AS (
  SELECT source, source_size, w, cap, first_value(open IGNORE NULLS) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM o
), t AS (
  SELECT source, source_size, coalesce(level * w, CAST(cap AS DOUBLE)) AS target FROM g
), q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id) AS stop FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT q.*, copy, CASE WHEN size > 0 THEN CAST(copy * source_size + stop AS DOUBLE) / target END AS finish FROM q, (VALUES (0), (1)) AS c(copy)
), m AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source, copy, turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up FROM i WHERE size > 0
), b AS (
  SELECT doc_id, CAST(sum(greatest(0, least(size, (SELECT CAST(floor(sum(target)) AS BIGINT) FROM t) - up + size))) AS BIGINT) AS taken FROM m GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN b ON q.doc_id = b.doc_id
"""

OP10 = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT doc_id, i, line, coalesce(doc_id <> holder, false) AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

OP12 = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('+' || lang, '') AS tree,
    -- the checksum's remainder register: each byte goes in, then eight steps
    list_reduce(list_prepend(4294967295, flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS register
  FROM documents
), t AS (
  SELECT *, coalesce(xor(register, 4294967295) % 7 = 0, false) AS hit FROM d
), l AS (
  SELECT row_number() OVER (ORDER BY tree, doc_id, leaf) AS rid, doc_id, tree, leaf, found, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, tree, {_LEAF.format("n_chars")} AS leaf, CASE WHEN hit THEN {_LEAF.format("(n_chars + 1)")} ELSE {_LEAF.format("n_chars")} END AS found FROM t)
), nodes AS (
  SELECT tree, 0 AS lvl, i, leaf AS h, n FROM l
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 2, n
), tops AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, i, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n
), steps AS (
  SELECT l.rid, v.lvl AS step, (l.i >> v.lvl) & 1 AS is_right, s.h FROM l JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1) AS v ON l.tree = v.tree
    LEFT JOIN nodes AS s ON s.tree = l.tree AND s.lvl = v.lvl AND s.i = xor(l.i >> v.lvl, 1)
  UNION ALL
  SELECT l.rid, 1000 + v.lvl, (tops.i >> v.lvl) & 1, s.h FROM l JOIN tops ON l.tree = tops.tree JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) AS v ON true
    LEFT JOIN crown AS s ON s.lvl = v.lvl AND s.i = xor(tops.i >> v.lvl, 1)
), path AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) - 1 AS k FROM steps
), fold AS (
  SELECT rid, 0 AS k, found AS h FROM l
  UNION ALL
  SELECT fold.rid, fold.k + 1, sha256(CASE WHEN path.h IS NULL THEN fold.h WHEN is_right = 1 THEN path.h || fold.h ELSE fold.h || path.h END) FROM fold JOIN path ON fold.rid = path.rid AND fold.k = path.k
), folded AS (
  SELECT rid, max_by(h, k) AS h FROM fold GROUP BY rid
), proof AS (
  SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM steps GROUP BY rid
), r AS (
  SELECT h AS root FROM crown WHERE n = 1
)
SELECT l.doc_id, l.leaf, tops.h AS subroot, r.root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = r.root AS verified
FROM l JOIN tops ON l.tree = tops.tree JOIN folded ON l.rid = folded.rid LEFT JOIN proof ON l.rid = proof.rid CROSS JOIN r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_approximation_top_k": OP1, "op4_weighted_fair_mixing": OP4, "op10_levelled_line_dedup": OP10, "op12_pregel_merkle_manifest": OP12}
