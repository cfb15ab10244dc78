"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_URLS = rf"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0
           THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest
  FROM pages),
judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
canon AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '')
         || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS url FROM judged),
listed AS (
  SELECT DISTINCT url FROM canon
  WHERE regexp_matches(host, 'casino|pills|bets|spam|poker|porn|xxx')),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fitting AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM canon JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM canon c LEFT JOIN fitting f ON c.page_id = f.page_id AND f.k = 1
LEFT JOIN listed l ON c.url = l.url
"""

_CONTAMINATION = rf"""
WITH normal AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark),
worded AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM normal),
sized AS (
  SELECT DISTINCT least(13, len(w)) AS s FROM worded WHERE kind = 'i' AND len(w) > 0),
windows AS (
  SELECT id AS item_id, list_aggregate(w[p : p + s - 1], 'string_agg', ' ') AS win
  FROM (SELECT id, w, least(13, len(w)) AS s,
               unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
        FROM worded WHERE kind = 'i' AND len(w) > 0)),
places AS (
  SELECT id, s, p, list_aggregate(w[p : p + s - 1], 'string_agg', ' ') AS win
  FROM (SELECT id, w, s, unnest(range(1, len(w) - s + 2)) AS p
        FROM worded, sized WHERE kind = 'd' AND len(w) >= s)),
found AS (SELECT DISTINCT id, s, p, item_id FROM places JOIN windows USING (win)),
hits AS (
  SELECT id, count(DISTINCT q) AS n_hit
  FROM (SELECT id, unnest(range(p, p + s)) AS q FROM found) GROUP BY id),
items AS (
  SELECT id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY id)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded d LEFT JOIN hits USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""

_LINES = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         len(string_split(text, chr(10))) AS n
  FROM documents),
worded AS (
  SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS words FROM split),
formed AS (
  SELECT doc_id, pos, words, [len(words)::VARCHAR] || words[1:3] AS leaf,
         [lag(words) OVER w, lead(words) OVER w] AS around
  FROM worded WHERE len(words) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
texts AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
in_leaf AS (
  SELECT DISTINCT leaf, content, around FROM (
    SELECT leaf, doc_id, arg_min(around, pos) AS around FROM formed GROUP BY ALL) JOIN texts USING (doc_id)),
live AS (SELECT leaf FROM in_leaf GROUP BY leaf HAVING count(DISTINCT around) >= 2),
forms AS (
  SELECT leaf, words, content, around, min(doc_id) AS first FROM (
    SELECT leaf, words, doc_id, arg_min(around, pos) AS around
    FROM formed JOIN live USING (leaf) GROUP BY ALL) JOIN texts USING (doc_id)
  GROUP BY ALL),
variants AS (SELECT leaf, words, count(*) AS n FROM forms GROUP BY ALL),
held AS (SELECT leaf, sum(n) AS leaf_n FROM variants GROUP BY leaf),
exploded AS (
  SELECT leaf, words, n, unnest(words) AS word, generate_subscripts(words, 1) AS place
  FROM variants),
shared AS (
  SELECT leaf, place, word, 1 AS fixed
  FROM (SELECT leaf, place, word, sum(n) AS n FROM exploded GROUP BY ALL) JOIN held USING (leaf)
  WHERE 3 * n > leaf_n),
shaped AS (
  SELECT leaf, words, len(words) AS n_words,
         CASE WHEN 2 * count(fixed) FILTER (WHERE place > 3) >= len(words) - 3
           THEN leaf || ['|'] || list(CASE WHEN fixed = 1 THEN word ELSE chr(2) END ORDER BY place)
           ELSE ['-'] || words END AS template
  FROM exploded LEFT JOIN shared USING (leaf, place, word) GROUP BY leaf, words),
known AS (
  SELECT template, min(first) AS first FROM forms JOIN shaped USING (leaf, words)
  GROUP BY template
  HAVING count(DISTINCT around) >= CASE WHEN min(n_words) >= 50 THEN 2 ELSE 3 END
     AND 4 * count(DISTINCT around) >= count(*)),
dropped AS (SELECT words, min(first) AS first FROM shaped JOIN known USING (template) GROUP BY words),
judged AS (
  SELECT w.*, len(w.words) > 0 AS full_line, d.first IS NOT NULL AND d.first <> doc_id AS gone
  FROM worded w LEFT JOIN dropped d ON w.words = d.words),
counted AS (
  SELECT doc_id, count_if(full_line) AS n_lines, count_if(full_line AND gone) AS n_gone,
         string_agg(line || CASE WHEN pos < n THEN chr(10) ELSE '' END, '' ORDER BY pos) AS whole,
         string_agg(line || CASE WHEN pos < n THEN chr(10) ELSE '' END, '' ORDER BY pos)
           FILTER (NOT (full_line AND gone)) AS rest
  FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(CASE WHEN n_gone = n_lines THEN 0 ELSE n_gone END AS BIGINT) AS n_dropped,
       sha256(CASE WHEN n_gone = n_lines THEN whole ELSE coalesce(rest, '') END) AS kept_sha256
FROM counted
"""

_CALLS = r"""
WITH RECURSIVE asked AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn AS position,
         CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name,
         conv_id || ':' || (turn - 2) AS parent_id, text,
         row_number() OVER (PARTITION BY conv_id, turn
                            ORDER BY role = 'system' DESC, text) AS k
  FROM conversations WHERE role <> 'assistant'),
calls AS (SELECT * FROM asked WHERE k = 1),
replies AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
levels AS (
  SELECT conv_id, call_id, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.parent_id)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1
  FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.parent_id = l.call_id),
joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
         c.name, c.position, CAST(l.level AS BIGINT) AS level, c.text, r.content,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'no result'
              ELSE 'linked' END AS status
  FROM calls c LEFT JOIN levels l ON c.conv_id = l.conv_id AND c.call_id = l.call_id
  FULL JOIN replies r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, name, position, level, status,
       CASE WHEN status = 'orphan' THEN NULL WHEN text IS NULL THEN 'text: missing'
            WHEN length(text) < 20 THEN 'text: too short' ELSE '' END AS errors,
       '{' || CASE WHEN status = 'orphan' THEN '' ELSE '"arguments":{'
         || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text)::VARCHAR || ',' END
         || '"turn":' || position || '},' END
       || '"id":' || to_json(call_id)::VARCHAR
       || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END
       || CASE WHEN name IS NULL THEN '' ELSE ',"name":' || to_json(name)::VARCHAR END
       || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END
       || ',"status":' || to_json(status)::VARCHAR || '}' AS record
FROM joined
"""

_POLYNOMIAL = r"""polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
"""

_SHARDS = rf"""
WITH {_POLYNOMIAL}bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'),
               lambda x: CAST('0x' || x AS BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, polynomial),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) - size AS start,
         sum(size) OVER () AS total FROM sized),
cut AS (
  SELECT *, CAST(((2 * start + size) * 16) // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

_MANIFEST = rf"""
WITH RECURSIVE {_POLYNOMIAL}
named AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, source, lang, n_chars, text,
         xor(list_reduce([4294967295] || list_transform(
               regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
               lambda x: CAST('0x' || x AS BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, polynomial),
leaves AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS slot,
         count(*) OVER (PARTITION BY g) AS n,
         sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + k)::VARCHAR) || ':' || (n_chars + k), '-') || tail)
           AS changed
  FROM (SELECT *, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS k,
               strlen(doc_id::VARCHAR) || ':' || doc_id
                 || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') AS head,
               coalesce(strlen(text) || ':' || text, '-') AS tail FROM named)),
nodes AS (
  SELECT g, 0 AS level, slot, leaf AS node, n FROM leaves
  UNION ALL
  SELECT g, level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY g, level, slot // 2, n),
tops AS (
  SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, slot, subroot AS node, n FROM tops
  UNION ALL
  SELECT level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (n + 1) // 2
  FROM upper_nodes WHERE n > 1 GROUP BY level, slot // 2, n),
sides AS (
  SELECT l.doc_id, v.level, CASE WHEN (l.slot >> v.level) & 1 = 1 THEN 'L' ELSE 'R' END
           || coalesce(s.node, '') AS side
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM nodes WHERE n > 1) v ON v.g = l.g
  LEFT JOIN nodes s ON s.g = l.g AND s.level = v.level AND s.slot = xor(l.slot >> v.level, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + v.level, CASE WHEN (t.slot >> v.level) & 1 = 1 THEN 'L' ELSE 'R' END
           || coalesce(s.node, '')
  FROM leaves l JOIN tops t ON t.g = l.g
  JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) v ON true
  LEFT JOIN upper_nodes s ON s.level = v.level AND s.slot = xor(t.slot >> v.level, 1)),
paths AS (
  SELECT doc_id, list(side ORDER BY level) AS path,
         string_agg(substr(side, 2), '' ORDER BY level) AS proof FROM sides GROUP BY doc_id),
folded AS (
  SELECT l.doc_id, l.leaf, t.subroot, (SELECT node FROM upper_nodes WHERE n = 1) AS root,
         sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce([changed] || coalesce(path, []), lambda a, x: CASE WHEN x[1] = 'L'
           THEN sha256(substr(x, 2) || a) ELSE sha256(a || substr(x, 2)) END) AS folded_root
  FROM leaves l JOIN tops t USING (g) LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM folded
"""

_DIVERGENCE = rf"""
WITH named AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
worded AS (
  SELECT lang, source, k,
         unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM named),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM worded GROUP BY ALL HAVING count(DISTINCT k) >= 30),
counted AS (
  SELECT lang, source, term, count(*) AS n FROM worded JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (
  SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM named) LEFT JOIN counted USING (lang, source)
  GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(n, 0) + 5)::HUGEINT // (total + 5 * v) AS BIGINT) AS p,
         CAST(1 + 1000000000 * (lang_n + 5)::HUGEINT // (lang_total + 5 * v) AS BIGINT) AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang)
  LEFT JOIN counted USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON a.lang = x.lang AND a.source = x.source
  LEFT JOIN shares y ON b.lang = y.lang AND b.source = y.source AND x.term = y.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                   ORDER BY value DESC, item) AS k FROM found)
WHERE part = 'pair' OR k <= 50
"""

CHECKS: dict[str, str] = {
    "op2_url_filters": _URLS,
    "op4_decontamination": _CONTAMINATION,
    "op6_line_dedup": _LINES,
    "op8_tool_calls": _CALLS,
    "op10_sharding": _SHARDS,
    "op11_merkle_manifest": _MANIFEST,
    "op12_source_divergence": _DIVERGENCE,
}
