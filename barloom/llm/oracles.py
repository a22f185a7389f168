"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from barloom.llm.common import UPPER

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

TOPK = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY doc_id, term),
len AS (SELECT doc_id, CAST(sum(n) AS DOUBLE) AS length FROM tf GROUP BY doc_id),
stats AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS docs, (SELECT sum(length) FROM len) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, ln(1 + ((SELECT docs FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM tf GROUP BY term),
q AS (SELECT doc_id AS query_id, term, weight FROM tf JOIN idf USING (term) WHERE doc_id % 50 = 0),
hits AS (SELECT query_id, tf.doc_id, round(sum(weight * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / (SELECT mean FROM stats))))), 9) AS score
  FROM q JOIN tf USING (term) JOIN len ON tf.doc_id = len.doc_id GROUP BY query_id, tf.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM hits
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""

LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
s AS (SELECT *, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS words FROM l),
k AS (SELECT doc_id, line, words FROM s WHERE len(words) >= 1),
f AS (SELECT words, min(row(doc_id, line)) AS first FROM k GROUP BY words),
v AS (SELECT words, first, place, array_to_string(words[:place - 1] || words[place + 1:], ' ') AS variant
  FROM (SELECT words, first, unnest(range(1, len(words) + 1)) AS place FROM f WHERE len(words) >= 10)),
sub AS (SELECT a.words FROM v a JOIN (SELECT variant, place, min(first) AS best FROM v GROUP BY variant, place) b USING (variant, place) WHERE b.best < a.first),
whole AS (SELECT words, first, array_to_string(words, ' ') AS variant FROM f WHERE len(words) >= 10),
longer AS (SELECT v.words FROM v JOIN whole USING (variant) WHERE whole.first < v.first),
shorter AS (SELECT whole.words FROM whole JOIN v USING (variant) WHERE v.first < whole.first),
near AS (SELECT words FROM sub UNION SELECT words FROM longer UNION SELECT words FROM shorter),
gone AS (SELECT doc_id, line FROM k JOIN f USING (words) WHERE row(doc_id, line) <> first OR words IN (SELECT words FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_dropped, coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN raw END, chr(10) ORDER BY l.line), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) ks(k)),
f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, k, a, phrase, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
inside AS (SELECT lang, a, array_to_string(ws[1:k - 1], ' ') AS phrase FROM parts UNION SELECT lang, a, array_to_string(ws[2:k], ' ') FROM parts),
kept AS (SELECT * FROM parts ANTI JOIN inside USING (lang, phrase, a)),
cuts AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, total.n, cut, CAST((CAST(1000 AS HUGEINT) * c.a * total.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:c.k], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295)"
TRIE = f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM o GROUP BY c),
h AS (SELECT s.c, s.c - s.c % 5 AS base, {_CRC.replace("CAST(c ", "CAST(s.c ")} % 9 AS h, s.n, coalesce(b.n, 0) AS nb FROM sizes s LEFT JOIN sizes b ON b.c = s.c - s.c % 5),
rebuilt AS (SELECT o.c, least(h, nb) + pos - h + 1 AS depth, r, x FROM o JOIN h ON o.c = h.c WHERE pos >= h UNION ALL SELECT h.c, pos + 1, r, x FROM o JOIN h ON o.c = base WHERE pos < least(h, nb)),
q AS (SELECT c, depth, array_to_string(list(sha256(length(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY depth), '|') AS key, strlen(x) AS bytes FROM rebuilt),
u AS (SELECT c, depth, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY depth), '') AS up, bytes FROM q UNION ALL SELECT c, 0, '', NULL, 0 FROM h),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM u),
node AS (SELECT key, depth, up, bytes, count(*) AS n_convs, min(c) AS conv_id, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS members FROM ended GROUP BY key, depth, up, bytes),
kids AS (SELECT up AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
below AS (SELECT DISTINCT a.key AS top, d.key FROM u a JOIN u d ON a.c = d.c AND d.depth >= a.depth),
sums AS (SELECT top AS key, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM below JOIN full_ USING (key) GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.members) AS ends_sha256 FROM full_ f JOIN sums USING (key) LEFT JOIN full_ p ON p.key = f.up
"""

ORACLES = {"op3_warc": WARC, "op9_topk": TOPK, "op10_lines": LINES, "op11_phrases": PHRASES, "op12_trie": TRIE}
