"""DuckDB SQL of the registered queries that SQL can express."""

OP3 = r"""
WITH rows_ AS (
  SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text
  FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
  SELECT conv_id, turn, string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2)
                                   ORDER BY role, text) AS step
  FROM rows_ GROUP BY conv_id, turn
), prefixes AS (
  SELECT conv_id, string_agg(turn || chr(3) || step, chr(4)) OVER w AS prefix, count(*) OVER w AS n_turns,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS n_copies
  FROM prefixes WHERE last GROUP BY prefix
), kept AS (
  SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE NOT last)
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1) // 4096 AS sub
  FROM (SELECT *, floor(turn / 1024.0)::BIGINT AS block FROM rows_ JOIN kept USING (conv_id))
), blocks AS (
  SELECT conv_id, block, sub, n_turns, n_copies, count(*) AS n_messages,
         string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10)
                    || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), ''
                    ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM numbered GROUP BY ALL
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block, sub) - 1 AS part, n_turns, n_copies, n_messages,
       sha256(rendered) AS rendered_sha256 FROM blocks
"""

OP4 = r"""
WITH lines AS (
  SELECT doc_id, i, raw,
         translate(trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), first AS (
  SELECT key, min(doc_id) AS first_id FROM lines
  WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.i, l.raw, coalesce(l.doc_id > f.first_id, false) AS gone
  FROM lines l LEFT JOIN first f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7 = r"""
WITH doc_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
    SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(len(w) - least(13, len(w)) + 1)) AS s
        FROM items WHERE len(w) > 0)
), lists AS (
  SELECT doc_id, list(word ORDER BY i) AS w FROM doc_words GROUP BY doc_id
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM lists JOIN sizes ON len(w) >= n)
), found AS (
  SELECT s.doc_id, s.n, s.s, w.item_id FROM spots s JOIN windows w ON s.n = w.n AND s.win = w.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(l.w), 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(l.w), false) AS contaminated
FROM documents d LEFT JOIN lists l USING (doc_id) LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

# crc32 has no function in DuckDB: one table of 256 entries, one step per byte
OP12 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)
), members AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
                                                                            lambda x: ascii(x)::BIGINT)),
                                     lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 9 AS h
  FROM members, crc_table
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h
), steps AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, strlen(text) AS bytes,
         sha256(length(role) || ',' || role || text) AS step
  FROM rebuilt
), paths AS (
  SELECT conv_id, depth, bytes, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM members
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY depth, path
), kids AS (
  SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtrees AS (
  SELECT left(v.path, 64 * v.d) AS path, sum(v.childless)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM (SELECT n.path, unnest(range(n.depth + 1)) AS d, (k.path IS NULL)::INT AS childless, (n.n_convs - 1) * n.bytes AS saved
        FROM nodes n LEFT JOIN kids k ON k.path = n.path) v GROUP BY 1
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1)
  GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, length(n.path) - 64)
LEFT JOIN kids k ON k.path = n.path JOIN subtrees s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
"""

OP13 = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT source_size, weight, row_number() OVER w AS k,
         (1.5 * (sum(source_size) OVER ())::DOUBLE
          - 2.0 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source)
), shared AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * weight <= 2.0 * source_size),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, weight * level)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN least(2.0 * source_size, weight * level)::DOUBLE / source_size ELSE 0 END AS rate
  FROM sources, shared
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
         ('0x' || left(md5('mix ' || coalesce('id ' || doc_id::VARCHAR, 'text ' || text, 'none')), 13))::BIGINT
         / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""

ORACLE = {"op3_chat_collapse": OP3, "op4_line_dedup": OP4, "op7_decontamination": OP7, "op12_prefix_trie": OP12,
          "op13_source_mixing": OP13}
