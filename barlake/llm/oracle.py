"""DuckDB SQL that the registered queries must equal, where SQL can express them."""

OP1 = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
parts AS (  -- short pieces with an overlap of 49 bytes: cutting long strings is slow
  SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS h
  FROM (SELECT doc_id, hex(b) AS h, unnest(generate_series(0, octet_length(b) // 500)) AS k FROM texts)),
places AS (SELECT doc_id, k, h, unnest(generate_series(1, least(500, len(h) // 2))) AS i FROM parts),
windows AS (SELECT doc_id, 500 * k + i AS i, substr(h, 2 * i - 1, 100) AS s FROM places WHERE 2 * i + 98 <= len(h)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > least),
marked AS (
  SELECT t.doc_id, t.p, t.x, coalesce(max(s.i) OVER (PARTITION BY t.doc_id ORDER BY t.p), -50) > t.p - 50 AS gone
  FROM (SELECT doc_id, 500 * k + i AS p, substr(h, 2 * i - 1, 2) AS x FROM places) t
  LEFT JOIN starts s ON s.doc_id = t.doc_id AND s.i = t.p),
edges AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM marked),
cut AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
         coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS left_over
  FROM edges GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed,
       CAST(coalesce(n_spans, 0) AS bigint) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)"""

OP9 = r"""
WITH split AS (
  SELECT doc_id AS id, false AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT item_id, true, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
windows AS (
  SELECT id AS item_id, least(13, len(w)) AS size, w[i:i + least(13, len(w)) - 1] AS words
  FROM (SELECT id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM split WHERE item AND len(w) > 0)),
places AS (SELECT id AS doc_id, w, unnest(generate_series(1, len(w))) AS p FROM split WHERE NOT item),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT doc_id, p, s.size, item_id
  FROM (SELECT doc_id, p, size, w[p:p + size - 1] AS words FROM places, sizes WHERE p + size - 1 <= len(w)) s
  JOIN windows x ON s.size = x.size AND s.words = x.words),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + size - 1)) AS p FROM (SELECT DISTINCT doc_id, p, size FROM found)),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item_id FROM found) GROUP BY doc_id),
counts AS (
  SELECT id AS doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
         coalesce(i.ids, '') AS ids
  FROM split LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) h ON h.doc_id = id
             LEFT JOIN items i ON i.doc_id = id
  WHERE NOT item)
SELECT doc_id, n_words, CAST(n_hit AS bigint) AS n_hit, CAST(n_items AS bigint) AS n_items,
       sha256(ids) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated
FROM counts"""

OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS bigint))),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS harm
  FROM (SELECT *, coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS name FROM conversations), crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM harmed WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 32), substr(text, 1, 64),
                               sha256(len(role) || ':' || role || text)) AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM damaged),
rated AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN substr(core, len(core), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed),
inserts(s, marks, lines, t) AS (VALUES  -- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
  (0, '', [], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', [], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
uses AS (  -- what may be done with a row in each state
  SELECT conv_id, n, s, 'D' AS mark, 4 AS price, [] AS line, s AS t FROM rated, range(4) AS states(s)
  UNION ALL
  SELECT conv_id, n, s, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, [role || ':' || text], t
  FROM rated JOIN (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS keeps(i, s, t) ON initial = i
  WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, n, s, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, [r || ':' || text], t
  FROM rated, (VALUES ('user', 0, 2), ('user', 1, 2), ('user', 3, 2), ('assistant', 2, 3)) AS roles(r, s, t)
  WHERE fault IN ('', 'truncated')),
convs AS (SELECT DISTINCT conv_id FROM conversations),
steps AS (
  SELECT conv_id, CAST(0 AS bigint) AS n, 0 AS s, {'cost': 0, 'audit': '', 'lines': CAST([] AS varchar[])} AS best FROM convs
  UNION ALL
  SELECT p.conv_id, u.n, u.t, min({'cost': CAST(p.best.cost + 3 * len(i.marks) + u.price AS integer), 'audit': p.best.audit || i.marks || u.mark,
                                   'lines': CAST(p.best.lines || i.lines || u.line AS varchar[])})
  FROM steps p JOIN inserts i ON i.s = p.s JOIN uses u ON u.conv_id IS NOT DISTINCT FROM p.conv_id AND u.n = p.n + 1 AND u.s = i.t
  GROUP BY p.conv_id, u.n, u.t),
sums AS (
  SELECT conv_id, max(n) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rated GROUP BY conv_id),
ends AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 3 * len(i.marks), 'audit': p.best.audit || i.marks,
                         'lines': CAST(p.best.lines || i.lines AS varchar[])}) AS best
  FROM steps p JOIN inserts i ON i.s = p.s AND i.t IN (0, 3)
       LEFT JOIN sums c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.n = coalesce(c.n, 0) GROUP BY p.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS bigint) AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN sums c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

OP12 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON a = doc_id"""

OP13 = """
WITH whole AS (
  SELECT DISTINCT CAST(vec_id AS bigint) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor_id, b.id AS other, b.label = a.label AS same, CAST(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM whole a JOIN whole b ON a.id <> b.id WHERE a.id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER ranked AS integer) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW ranked AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER ranked <= 3"""

ORACLE = {"op1_suffix_dedup": OP1, "op9_decontaminate": OP9, "op11_conversation_repair": OP11, "op12_divide_skip": OP12,
          "op13_bond_negatives": OP13}
