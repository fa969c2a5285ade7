"""DuckDB SQL of the registered queries that SQL can express."""

BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT r, page_id, coalesce({LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT p.r, rules.host || rules.path AS rule, rules.verdict,
  row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host || rules.path) DESC) AS best
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE best = 1) USING (r)
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, [{LOWER.format("x")} for x in {WORDS}] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g, len(ws) < 5 AS short FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON c.d = e.a AND c.r < e.b)
SELECT d AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.d GROUP BY 1
"""

OP5 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER.format("trim(line, " + BLANK + ")")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.holder AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY 1
"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p LEFT JOIN k USING (payload_digest)
"""

OP9 = f"""
WITH q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source, len({WORDS}) AS size, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5)
  / 4503599627370496.0) / coalesce(weight, 1.0) AS key FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER t AS rank, ((SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW t AS (ORDER BY source_size / weight, number)),
f AS (SELECT min(rank) AS first FROM o WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR rank < first THEN 3.0 * source_size
  ELSE (SELECT level FROM o o2, f f2 WHERE o2.rank = f2.first) * weight END::DOUBLE AS target FROM o, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.*, e.source_size, target, epochs, target - epochs * e.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, pos, ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2] AS g FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS pos FROM d WHERE len(ws) >= 3)),
t AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM p) WHERE k >= 2),
r AS (SELECT doc_id, count(DISTINCT pos + o) AS n FROM t, (VALUES (0), (1), (2)) AS v(o) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE trim(line, {BLANK}) <> '' GROUP BY 1),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.u, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept FROM b
"""

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
f AS (SELECT d.doc_id, part, good, toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
  100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 2 * length(d.text), regexp_matches(d.text, '[#$%&*|]'),
  coalesce(d.doc_id > least, false)] AS fails FROM d JOIN m ON d.text = m.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n,
  len(list_filter(fails, lambda x: x)) AS bad FROM f GROUP BY ALL),
v(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS own,
  [ascii(y) - 64 for y in string_split(substr(filter_order, 1, step - 1), '') if y <> ''] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT part, filter_order, step::INTEGER AS step, fails[own] AS own_fails, len(list_filter(before, lambda b: fails[b])) > 0 AS earlier, good, toxic, n, bad FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT own_fails AND NOT earlier), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (own_fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own_fails AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (own_fails AND bad = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n * good) FILTER (own_fails AND NOT earlier), 0)::BIGINT AS good_lost,
  coalesce(sum(n * toxic) FILTER (own_fails AND NOT earlier), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(bad, 1)) FILTER (own_fails), 0)::BIGINT AS shapley
FROM j GROUP BY 1, 2, 3
"""

ORACLE = {"op2_url_filter": OP2, "op4_ngram_jaccard_join": OP4, "op5_line_dedup": OP5, "op8_warc": OP8, "op9_source_mixing": OP9, "op10_quality_rules": OP10,
          "op12_filter_audit": OP12}
