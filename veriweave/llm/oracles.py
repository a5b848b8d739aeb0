"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
starts AS (
  SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS w FROM starts),
places AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM texts WHERE len(ws) > 0),
runs AS (
  SELECT rid, p, size, array_to_string(ws[p:p + size - 1], ' ') AS w
  FROM places JOIN (SELECT DISTINCT size FROM windows) ON p + size - 1 <= len(ws)),
found AS (SELECT rid, p, size, item_id FROM runs JOIN windows USING (size, w)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + size)) AS q FROM found) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

CHAT_FORMAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*[|]')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SUFFIX_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, (length(h) // 2)::BIGINT AS n FROM docs),
cuts AS (SELECT rid, h, n, unnest(range(0, n - 99, 400)) AS c FROM sized WHERE n >= 100),
pieces AS (SELECT rid, c, substr(h, 2 * c + 1, 998) AS piece, least(400, n - 99 - c) AS m FROM cuts),
starts AS (SELECT rid, c, piece, unnest(range(0, m)) AS q FROM pieces),
ranked AS (SELECT rid, c + q AS p, row_number() OVER (PARTITION BY md5(substr(piece, 2 * q + 1, 200)) ORDER BY rid, c + q) AS k FROM starts),
again AS (SELECT rid, p, p > coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1000) + 100 AS new FROM ranked WHERE k > 1),
islands AS (SELECT rid, p, sum(new::INT) OVER (PARTITION BY rid ORDER BY p) AS i FROM again),
spans AS (SELECT rid, min(p) AS a, max(p) + 100 AS b FROM islands GROUP BY rid, i),
edges AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
totals AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY rid),
heads AS (SELECT e.rid, string_agg(substr(s.h, 2 * e.before + 1, 2 * (e.a - e.before)), '' ORDER BY e.a) AS head FROM edges e JOIN sized s USING (rid) GROUP BY e.rid)
SELECT s.doc_id, s.n AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(x.head, '') || substr(s.h, 2 * coalesce(t.last, 0) + 1))) AS kept_sha256
FROM sized s LEFT JOIN totals t USING (rid) LEFT JOIN heads x USING (rid)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
places AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS p FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT rid, hash(array_to_string(ws[p:p + 4], ' ')) AS s FROM places),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
pairs AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid < y.rid GROUP BY x.rid, y.rid),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.rid = a JOIN sizes n ON n.rid = b WHERE 100 * common >= 75 * (m.n + n.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rid, other) AS (SELECT rid, rid FROM words UNION SELECT r.rid, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT w.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links
FROM reach r JOIN words w USING (rid) JOIN words o ON o.rid = r.other LEFT JOIN sizes z ON z.rid = r.rid
LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) k ON k.a = r.rid
GROUP BY r.rid, w.doc_id
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE
tab AS (
  SELECT list(c ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
kinds AS (
  SELECT given.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
                                  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM given, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM damaged),
marked AS (
  SELECT conv_id, turn, i, role, text, role[1:1] AS c,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (
  SELECT convs.conv_id, count(i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs LEFT JOIN marked ON convs.conv_id IS NOT DISTINCT FROM marked.conv_id GROUP BY convs.conv_id),
-- Insertions before a row: state, state after them, how many, their lines.
ins(q, q1, k, said) AS (
  VALUES (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'),
         (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:')),
-- What may be done with a row: initial it needs (or any), state before and after, cost, role it gets (or keeps its own).
edits(q1, needs, e, q2, price, gets) AS (
  VALUES (0, NULL, 'D', 0, 2, NULL), (1, NULL, 'D', 1, 2, NULL), (2, NULL, 'D', 2, 2, NULL), (3, NULL, 'D', 3, 2, NULL),
         (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (3, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL),
         (0, NULL, 'R', 2, 1, 'user'), (1, NULL, 'R', 2, 1, 'user'), (3, NULL, 'R', 2, 1, 'user'), (2, NULL, 'R', 3, 1, 'assistant')),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {cost: 0::BIGINT, audit: '', said: ''} AS l FROM convs
  UNION ALL
  SELECT p.conv_id, m.i, e.q2,
         min({cost: p.l.cost + 5 * ins.k + e.price + CASE WHEN e.e <> 'D' AND m.fault = 't' THEN 5 ELSE 0 END,
              audit: p.l.audit || repeat('I', ins.k) || e.e,
              said: p.l.said || ins.said || CASE WHEN e.e = 'D' THEN '' ELSE chr(10) || coalesce(e.gets, m.role) || ':' || m.text END})
  FROM paths p JOIN marked m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = p.i + 1
  JOIN ins ON ins.q = p.q JOIN edits e ON e.q1 = ins.q1
  WHERE (e.e = 'D' OR m.fault NOT IN ('b', 'd')) AND (e.needs IS NULL OR e.needs = m.c)
  GROUP BY p.conv_id, m.i, e.q2),
ends AS (
  SELECT c.conv_id, min({cost: p.l.cost + 5 * ins.k, audit: p.l.audit || repeat('I', ins.k), said: p.l.said || ins.said}) AS l
  FROM counted c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n
  JOIN ins ON ins.q = p.q WHERE ins.q1 = 3 OR (ins.q1 = 0 AND ins.k = 0) GROUP BY c.conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, l.cost AS cost, l.audit AS audit, sha256(l.said[2:]) AS repaired_sha256
FROM counted c JOIN ends ON c.conv_id IS NOT DISTINCT FROM ends.conv_id
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN counted ON counted.a = v.r
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b)::INTEGER AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
