"""SQL (DuckDB) that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from palisade.llm.licenses import template_sql

OP1 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

OP2 = r"""
WITH captures AS (
  SELECT page_id, url, ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 8760 AS ts,
    regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\.$', '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS code FROM captures WHERE host <> ''),
h AS (SELECT *, (code % 120) * 24 AS t, array_to_string(string_split(host, '.')[-3:], '.') AS parent FROM hosts),
changes AS (
  SELECT DISTINCT * FROM (
    SELECT 'spam' AS list, 'host' AS kind, host AS value, t AS ts, false AS off, false AS allow FROM h WHERE code % 3 = 0
    UNION ALL SELECT 'spam', 'host', host, t + 90 * 24, true, false FROM h WHERE code % 6 = 0
    UNION ALL SELECT 'spam', 'host', host, t + 200 * 24, false, false FROM h WHERE code % 12 = 0
    UNION ALL SELECT 'adult', 'domain', parent, t + 60 * 24, false, false FROM h WHERE code % 7 = 0
    UNION ALL SELECT 'adult', 'domain', parent, t + 150 * 24, true, false FROM h WHERE code % 14 = 0
    UNION ALL SELECT 'trusted', 'host', host, t + 30 * 24, false, true FROM h WHERE code % 5 = 0
    UNION ALL SELECT 'trusted', 'host', host, t + 160 * 24, true, true FROM h WHERE code % 10 = 0
    UNION ALL SELECT 'language', 'prefix', host || '/en', t, false, false FROM h WHERE code % 11 = 0)),
known AS (SELECT list, kind, value, ts, bool_or(off) AS off, bool_or(allow) AS allow FROM changes GROUP BY ALL),
turned AS (SELECT * FROM (SELECT *, lag(off, 1, true) OVER (PARTITION BY list, kind, value ORDER BY ts) AS before FROM known) WHERE off <> before),
entries AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY list, kind, value ORDER BY ts) AS until FROM turned) WHERE NOT off),
keys AS (
  SELECT page_id, ts, 'host' AS kind, host AS value, 20000 AS rank FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, ts, 'domain', array_to_string(string_split(host, '.')[i:], '.'), 10000 - i FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS r(i) WHERE host <> ''
  UNION ALL SELECT page_id, ts, 'prefix', host || '/' || array_to_string(parts[1:i], '/'), 30000 + i FROM captures, unnest(range(1, len(parts) + 1)) AS r(i) WHERE host <> ''),
hits AS (
  SELECT k.page_id, e.list, e.kind, e.value, e.allow,
    row_number() OVER (PARTITION BY k.page_id ORDER BY NOT e.allow, -k.rank, e.list, e.kind, e.value) AS r, count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keys k JOIN entries e ON k.kind = e.kind AND k.value = e.value AND e.ts <= k.ts AND (e.until IS NULL OR k.ts < e.until))
SELECT c.page_id, coalesce(h.n, 0) AS n_entries, coalesce(h.allow, true) AS accepted, h.list, h.kind, h.value
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""

OP3 = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM s, unnest(range(1, len(lines) + 1)) AS r(i)),
c AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT l.*, c.key IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

OP7 = r"""
WITH templates(template, license, text) AS (VALUES %s),
tokens AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM templates) WHERE term <> '' GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL) WHERE term <> ''),
total AS (SELECT count(DISTINCT doc_id) AS n FROM held),
df AS (SELECT term, count(*) AS n FROM held GROUP BY term),
terms AS (SELECT term, ln((total.n + 1.0::DOUBLE) / (coalesce(df.n, 0) + 1.0::DOUBLE)) + 1 AS idf FROM (SELECT term FROM df UNION SELECT term FROM tokens) LEFT JOIN df USING (term), total),
of_template AS (SELECT template, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS size FROM tokens JOIN terms USING (term)),
d AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?i)copyright *(\(c\)|©)? *[0-9]{4}([ ,-]+[0-9]{4})*,?', '', 'g'), chr(10)) AS lines, doc_id %% 5 = 0 AS declares FROM documents WHERE text IS NOT NULL),
said AS (
  SELECT doc_id, unnest(lines) AS said FROM d UNION SELECT doc_id, unnest(flatten(list_transform(lines, lambda x: string_split_regex(x, '[.!?;] +')))) FROM d
  UNION SELECT doc_id, unnest(string_split_regex(text, '\n([^A-Za-z0-9\n]*\n)+')) FROM d UNION SELECT doc_id, text FROM d WHERE declares),
counted AS (SELECT doc_id, said, term, count(*) AS tf FROM (SELECT doc_id, said, unnest(string_split_regex(lower(said), '[^a-z0-9]+')) AS term FROM said) WHERE term <> '' GROUP BY ALL),
weighed AS (SELECT doc_id, said, term, tf * idf AS w FROM counted JOIN terms USING (term)),
length AS (SELECT doc_id, said, sqrt(sum(w * w)) AS len FROM weighed GROUP BY ALL),
scored AS (
  SELECT x.doc_id, o.license, round(sum(x.w * o.w / o.size) / any_value(l.len), 6) AS score
  FROM weighed x JOIN of_template o USING (term) JOIN length l ON l.doc_id = x.doc_id AND l.said = x.said GROUP BY x.doc_id, x.said, o.template, o.license),
own AS (SELECT * FROM (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM scored WHERE score >= 0.7) WHERE r = 1),
paths AS (
  SELECT doc_id, CASE doc_id %% 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/b' || (doc_id // 100) END AS dir,
    CASE WHEN doc_id %% 5 = 0 THEN 'LICENSE-' || doc_id ELSE 'd' || doc_id || '.txt' END AS name
  FROM documents),
files AS (SELECT p.*, o.license, o.score FROM paths p LEFT JOIN own o USING (doc_id)),
declared AS (SELECT * FROM (SELECT dir, license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, doc_id) AS r FROM files WHERE doc_id %% 5 = 0 AND license IS NOT NULL) WHERE r = 1),
nearest AS (
  SELECT x.dir, arg_max(d.license, length(d.dir)) AS inherited, arg_max(d.dir, length(d.dir)) AS declared_in
  FROM (SELECT DISTINCT dir FROM files) x JOIN declared d ON x.dir = d.dir OR starts_with(x.dir, d.dir || '/') GROUP BY x.dir)
SELECT doc_id, f.dir || '/' || name AS path, coalesce(license, inherited) AS license,
  CASE WHEN license IS NOT NULL AND doc_id %% 5 = 0 THEN 'licence file' WHEN license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS source,
  score, CASE WHEN license IS NULL THEN declared_in END AS declared_in
FROM files f LEFT JOIN nearest n ON f.dir = n.dir
""" % template_sql()

OP10 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS run FROM w, unnest(range(1, len(words) - 33)) AS r(i)),
again AS (SELECT run FROM starts GROUP BY run HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM starts SEMI JOIN again USING (run)),
placed AS (SELECT doc_id, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS r(i)),
marked AS (SELECT p.*, max(h.i IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS 34 PRECEDING) AS gone FROM placed p LEFT JOIN hit h ON p.doc_id = h.doc_id AND p.i = h.i)
SELECT w.doc_id, count(m.i) AS n_words, count(*) FILTER (m.gone) AS n_removed, sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (NOT m.gone), '')) AS kept_sha256
FROM w LEFT JOIN marked m ON w.doc_id = m.doc_id GROUP BY w.doc_id
"""

#: A run shares words with itself one period on over at least six words in a row, so equal stretches of six words show every one.
OP11 = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
coded AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
s AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM coded),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM s),
repeated AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM placed),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM repeated),
words AS (SELECT doc_id, i, w[i + 1] AS word FROM d, unnest(range(len(w))) AS r(i)),
six AS (SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS k, array_to_string(w[i + 1:i + 6], ' ') AS said FROM d, unnest(range(len(w) - 5)) AS r(i)),
again AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.k = y.k AND x.said = y.said AND x.i < y.i),
islands AS (SELECT doc_id, p, min(i) AS start, count(*) + 5 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM again) GROUP BY doc_id, p, island),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM islands WHERE length >= 12 AND length >= 2 * p GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    arg_max({'s': start, 'l': length, 'p': period}, length * 1000000000000 - start * 1000000 - period) AS top
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)),
kept AS (SELECT w.doc_id, sha256(string_agg(word, ' ' ORDER BY w.i)) AS collapsed_sha256 FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP12 = r"""
WITH split AS (
  SELECT 'd' AS of, doc_id AS id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
  UNION ALL SELECT 'q', item_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
terms AS (SELECT of, id, term FROM (SELECT of, id, unnest(t) AS term FROM split) WHERE term <> ''),
query AS (SELECT DISTINCT id AS item_id, term FROM terms WHERE of = 'q'),
tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM terms WHERE of = 'd' GROUP BY id, term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf JOIN whole ON true WHERE term IN (SELECT term FROM query) GROUP BY term, n_docs),
score AS (
  SELECT q.item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))))::BIGINT AS score
  FROM query q JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id) JOIN whole ON true GROUP BY q.item_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
