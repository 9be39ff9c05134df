"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
w AS (SELECT source, source_size, [2.0, 1.0, 0.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS tilt, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM src),
r AS (SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
lev AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM src) - coalesce(sum(stop) OVER f, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER f, 0)) AS level
  FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT min_by(level, place) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM lev) WHERE level <= ratio),
goal AS (SELECT lev.source, source_size, tilt, least(stop, coalesce(open.level * weight, stop)) AS target FROM lev, open),
placed AS (
  SELECT rows.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM rows)
SELECT doc_id, size, source_size, target, CAST(size * (CASE WHEN once THEN 1 ELSE 0 END + CASE WHEN twice THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CASE WHEN once THEN round(CASE WHEN tilt = 1 THEN s1 ELSE (sqrt(greatest(tilt * tilt + 4 * (1 - tilt) * s1, 0)) - tilt) / (2 * (1 - tilt)) END, 9) END AS position_1,
  CASE WHEN twice THEN round(CASE WHEN tilt = 1 THEN s2 ELSE (sqrt(greatest(tilt * tilt + 4 * (1 - tilt) * s2, 0)) - tilt) / (2 * (1 - tilt)) END, 9) END AS position_2
FROM (
  SELECT p.doc_id, p.size, g.source_size, g.target, g.tilt, p.size > 0 AND p.first + p.size / 2.0 < g.target AS once, p.size > 0 AND g.source_size + p.first + p.size / 2.0 < g.target AS twice,
         p.first::DOUBLE / nullif(g.target, 0) AS s1, (g.source_size + p.first)::DOUBLE / nullif(g.target, 0) AS s2
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source)
"""

NEAREST = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

ORACLE_SQL = {"op5_mixing": MIXING, "op10_vectors": NEAREST}

TOOL_CALLS = r"""
WITH asked AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' AS key FROM conversations WHERE role IN ('user', 'system')),
answers AS (SELECT conv_id, turn - 1 AS asked_turn, min_by(text, (turn, text)) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
before AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn >= 2 THEN CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn - 2 AS VARCHAR) || ':reply' WHEN a.turn = 1 THEN CAST(a.conv_id AS VARCHAR) || ':0:configure' END AS need FROM asked a WHERE role = 'user'),
made AS (
  SELECT conv_id, turn, 0 AS level, 0 AS call_index, key || 'configure' AS call_id, 'configure' AS name, '{"prompt":' || CAST(to_json(text) AS VARCHAR) || '}' AS arguments, '' AS bad, NULL AS need FROM asked WHERE role = 'system'
  UNION ALL SELECT conv_id, turn, 0, 0, key || 'read', 'read', '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}', '', need FROM asked JOIN before USING (conv_id, turn) WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 1, 1, key || 'count', 'count', '{"limit":' || CASE WHEN w % 2 = 0 THEN CAST(w // 2 AS VARCHAR) ELSE CAST(w // 2 AS VARCHAR) || '.5' END || ',"words":' || w || '}', CASE WHEN w % 2 = 0 THEN '' ELSE 'limit is no integer' END, NULL
    FROM (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM asked WHERE role = 'user')
  UNION ALL SELECT conv_id, turn, 2, 2, key || 'reply', 'reply', '{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}', '', NULL FROM asked WHERE role = 'user'),
c AS (
  SELECT m.conv_id, m.turn, level, call_index, call_id, name, arguments, CASE WHEN name IN ('configure', 'reply') THEN r.content WHEN name = 'read' THEN string_split(r.content, chr(10))[1] END AS content,
         r.conv_id IS NOT NULL AND name <> 'count' AND (name <> 'read' OR r.content IS NOT NULL) AS linked, CASE WHEN need IS NOT NULL AND need NOT IN (SELECT call_id FROM made) THEN 'no call ' || need ELSE bad END AS errors
  FROM made m LEFT JOIN answers r ON r.conv_id = m.conv_id AND r.asked_turn = m.turn),
lost AS (SELECT conv_id, turn, text, CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) || ':' AS key FROM conversations WHERE role = 'assistant' AND (conv_id, turn - 1) NOT IN (SELECT (conv_id, turn) FROM asked WHERE role = 'user'))
SELECT conv_id, turn, level, call_index, call_id, name, linked, CASE WHEN errors <> '' THEN 'invalid' WHEN NOT linked THEN 'unanswered' ELSE 'ok' END AS status, errors,
       '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '"' || CASE WHEN content IS NOT NULL THEN ',"result":' || CAST(to_json(content) AS VARCHAR) ELSE '' END || ',"turn":' || CAST(turn AS VARCHAR) || '}' AS message
FROM c
UNION ALL SELECT conv_id, turn, NULL, NULL, key || n, NULL, FALSE, 'orphan', '', '{"id":"' || key || n || '"' || CASE WHEN content IS NOT NULL THEN ',"result":' || CAST(to_json(content) AS VARCHAR) ELSE '' END || ',"turn":' || turn || '}'
FROM (SELECT l.*, n, CASE WHEN n = 'read' THEN string_split(text, chr(10))[1] ELSE text END AS content FROM lost l CROSS JOIN (VALUES ('configure'), ('read'), ('reply')) v(n))
WHERE (n <> 'read' OR content IS NOT NULL) AND key || n NOT IN (SELECT call_id FROM made)
"""


def _licences(threshold: float = 0.8) -> str:
    from quillmere.llm.licences import TEMPLATES, bigrams_of

    rows = ",\n  ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams_of(text))}])" for name, text in TEMPLATES.items())
    return rf"""
WITH t(licence, own) AS (VALUES
  {rows}),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS p FROM documents WHERE regexp_matches(text, '\n[ \t\r]*\n')) WHERE contains(p, chr(10))),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM units),
g AS (SELECT doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams FROM w WHERE len(words) BETWEEN 2 AND 1000),
p AS (SELECT doc_id, licence, grams, own, len(own) AS b FROM g JOIN t ON len(grams) >= len(own) * {threshold} / (2 - {threshold}) AND len(grams) <= len(own) * (2 - {threshold}) / {threshold} WHERE list_has_any(grams, own)),
d AS (SELECT doc_id, licence, 2.0::DOUBLE * list_sum(list_transform(list_intersect(list_distinct(grams), own), lambda x: least(len(list_filter(own, lambda y: y = x)), len(list_filter(grams, lambda z: z = x))))) / (len(grams) + b) AS dice FROM p)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) AS n_units FROM d WHERE dice >= {threshold} GROUP BY doc_id, licence
"""


ORACLE_SQL |= {"op1_tool_calls": TOOL_CALLS, "op7_licences": _licences()}

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(h) // 2 - 49, 0)), lambda p: substr(h, 2 * p + 1, 100))) AS s, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.least),
b AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS q, unnest(list_transform(range(0, len(h) // 2), lambda q: substr(h, 2 * q + 1, 2))) AS x FROM d),
k AS (SELECT b.doc_id, b.q, b.x, coalesce(max(c.p) OVER (PARTITION BY b.doc_id ORDER BY b.q) >= b.q - 49, FALSE) AS gone FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.p = b.q),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY q), FALSE) AS starts FROM k),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(x, '' ORDER BY q) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

NEAR_COPIES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(least, s.doc_id)) AS kept FROM s LEFT JOIN c USING (doc_id)
"""

ORACLE_SQL |= {"op3_suffix_array": REPEATS, "op8_minhash": NEAR_COPIES}

REPAIR = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * len(key)), lambda j: CASE WHEN j % 8 = 0 THEN ascii(key[j // 8 + 1]) ELSE 0 END::BIGINT)),
         lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) % 20 AS hit FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc)),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) - 1 AS i, regexp_extract(text, '({_WORD[:-1]})[\x20\x09-\x0D]*$', 1) AS last FROM rows),
faulty AS (SELECT *, role[1] AS initial, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM said),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty) GROUP BY conv_id),
moves(q, letter, cost, initial, nq) AS (VALUES (0, 'K', 0, 's', 1), (0, 'K', 0, 'u', 2), (1, 'K', 0, 'u', 2), (2, 'K', 0, 'a', 3), (3, 'K', 0, 'u', 2), (0, 'D', 3, '', 0), (1, 'D', 3, '', 1), (2, 'D', 3, '', 2), (3, 'D', 3, '', 3), (0, 'R', 2, '', 2), (1, 'R', 2, '', 2), (2, 'R', 2, '', 3), (3, 'R', 2, '', 2)),
more(q, letters, cost, said, nq) AS (VALUES (0, '', 0, [], 0), (1, '', 0, [], 1), (2, '', 0, [], 2), (3, '', 0, [], 3), (0, 'I', 2, ['user:'], 2), (1, 'I', 2, ['user:'], 2), (2, 'I', 2, ['assistant:'], 3), (3, 'I', 2, ['user:'], 2),
  (0, 'II', 4, ['user:', 'assistant:'], 3), (1, 'II', 4, ['user:', 'assistant:'], 3), (2, 'II', 4, ['assistant:', 'user:'], 2), (3, 'II', 4, ['user:', 'assistant:'], 3)),
best(conv_id, i, q, v) AS (
  SELECT conv_id, 0, 0, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} FROM facts
  UNION ALL
  SELECT b.conv_id, b.i + 1, m.nq, min({{'cost': b.v.cost + p.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': b.v.audit || p.letters || m.letter,
    'said': b.v.said || p.said || CASE m.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.nq WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || f.text] END}})
  FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i JOIN more p ON p.q = b.q JOIN moves m ON m.q = p.nq AND (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (m.letter <> 'K' OR m.initial = f.initial)
  GROUP BY b.conv_id, b.i + 1, m.nq),
done AS (SELECT b.conv_id, min({{'cost': b.v.cost + p.cost, 'audit': b.v.audit || p.letters, 'said': b.v.said || p.said}}) AS v FROM best b JOIN facts USING (conv_id) JOIN more p ON p.q = b.q WHERE b.i = n AND p.nq IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v.cost, 0) AS BIGINT) AS cost, coalesce(v.audit, '') AS audit,
       sha256(coalesce(array_to_string(v.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE_SQL |= {"op12_repair": REPAIR}

HARD_NEGATIVES = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE_SQL |= {"op13_hard_negatives": HARD_NEGATIVES}
