"""SQL equivalents, in DuckDB's dialect, of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op8_ngram_jaccard"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id,
           CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS shingle
    FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS spots(i)
    WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM sets AS x JOIN sets AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    JOIN sizes AS nx ON nx.doc_id = x.doc_id JOIN sizes AS ny ON ny.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
    HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT reach.doc_id, CAST(coalesce(max(sizes.n), 0) AS BIGINT) AS n_shingles,
       min(reach.other) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id
GROUP BY reach.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op2_decontamination"] = rf"""
WITH docs AS (
    SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
), items AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, w[i : i + 9] AS words
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS spots(i)
    WHERE len(w) > 0
), places AS (
    SELECT doc_id, i AS start, size, w[i : i + size - 1] AS words
    FROM docs, (SELECT DISTINCT len(words) AS size FROM windows) AS sizes,
         unnest(range(1, len(w) - size + 2)) AS spots(i)
), hits AS (
    SELECT doc_id, start, size, item_id FROM places JOIN windows USING (words)
), hit_words AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM hits, unnest(range(start, start + size)) AS inside(pos) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS named
    GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op7_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), numbered AS (
    SELECT doc_id, i - 1 AS line_no, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
    FROM split, unnest(range(1, len(ls) + 1)) AS spots(i)
), lines AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos
    FROM numbered WHERE line <> ''
), packed AS (
    SELECT doc_id, list(line ORDER BY pos) AS ls FROM lines GROUP BY doc_id
), runs AS (
    SELECT doc_id, i AS pos, size, ls[i : i + size - 1] AS run
    FROM packed, (SELECT 1 << k AS size FROM range(0, 12) AS powers(k)) AS sizes,
         unnest(range(1, len(ls) - size + 2)) AS spots(i)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS copy FROM runs
), later AS (
    SELECT * FROM ranked WHERE copy > 1
), dropped AS (
    SELECT DISTINCT later.doc_id, lines.line_no
    FROM later JOIN lines ON lines.doc_id = later.doc_id
    WHERE (size = 2 AND lines.pos IN (later.pos, later.pos + 1))
       OR (size = 1 AND lines.pos = later.pos
           AND len(regexp_split_to_array(lines.line, '[\x20\x09-\x0D]+')) >= 8)
), removed AS (
    SELECT doc_id, count(*) AS n_removed,
           string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed
    FROM dropped GROUP BY doc_id
), shared AS (
    SELECT doc_id, max(size) AS shared_lines FROM later GROUP BY doc_id
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed, '') AS removed, CAST(coalesce(shared_lines, 0) AS BIGINT) AS shared_lines
FROM split LEFT JOIN removed USING (doc_id) LEFT JOIN shared USING (doc_id)
"""

# The tree's levels written out: more than any table of a few million rows needs. A level above the
# last has one node, which passes through.
def _rising(leaves: str, prefix: str, levels: int) -> str:
    steps = []
    for k in range(levels):
        below = leaves if k == 0 else f"{prefix}{k}"
        steps.append(f"""{prefix}{k}_runs AS (
    SELECT tree, i, h, n,
           CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (
               run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
           CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (
               run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r
    FROM {below} WINDOW run AS (PARTITION BY tree, i // 8 ORDER BY i)
), {prefix}{k + 1} AS (
    SELECT tree, i // 8 AS i, (n + 7) // 8 AS n,
           CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
    FROM {below} GROUP BY tree, i // 8, n
)""")
    return ", ".join(steps)


def _folding(rows: str, prefix: str, levels: int, tree: str, name: str) -> str:
    """Each row's digest and proof carried up the levels; a level without siblings has one node."""
    steps = []
    for k in range(levels):
        steps.append(f"""{name}{k + 1} AS (
    SELECT x.* REPLACE (x.i // 8 AS i, x.proof || s.l || s.r AS proof,
               CASE WHEN s.n = 1 THEN x.f ELSE sha256(s.l || x.f || s.r) END AS f)
    FROM {rows if k == 0 else f"{name}{k}"} AS x
    JOIN {prefix}{k}_runs AS s ON s.tree = {tree} AND s.i = x.i
)""")
    return ", ".join(steps)


def _coded(*columns: str) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts)


_CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
               lambda c: CAST(ascii(c) AS BIGINT)),
               lambda crc, b: list_reduce([xor(crc, b)] || range(8),
                   lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
_AS_READ = _coded("doc_id", "source", "lang", "n_chars", "text")
_LOWER = _coded("doc_id", "source", "lang", "n_chars", _LOWERED)

SQL["op13_merkle_manifest"] = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_AS_READ}) AS h,
           CASE WHEN {_CRC32} % 3 = 0 THEN sha256({_LOWER}) ELSE sha256({_AS_READ}) END AS f
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h, f) - 1 AS i,
           count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
), {_rising("placed", "low", 9)}, subroots AS (
    SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i,
           count(*) OVER () AS n
    FROM low9
), {_rising("subroots", "high", 3)}, start AS (
    SELECT doc_id, tree, h AS leaf, i, f, '' AS proof FROM placed
), {_folding("start", "low", 9, "x.tree", "up")}, middle AS (
    SELECT x.* REPLACE (s.i AS i), s.h AS subroot FROM up9 AS x JOIN subroots AS s ON s.name = x.tree
), {_folding("middle", "high", 3, "''", "over")}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = root.h AS verified
FROM over3, high3 AS root
"""

SQL["op11_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS s
    FROM rows AS a JOIN rows AS r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, s AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS INT)
           AS rank,
       vec_id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY rank <= 3
"""
