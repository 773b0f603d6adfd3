"""DuckDB SQL for the rows of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP10 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {BLANKS}), '{UPPER}', '{LOWER}') AS key
      FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
h AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.doc_id, l.i, l.line, h.key IS NOT NULL AND h.keep <> l.doc_id AS gone FROM l LEFT JOIN h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP1 = f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS p FROM pages),
h AS (SELECT page_id, translate(p.host, '{UPPER}', '{LOWER}') AS host, p.path AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.page_id = f.page_id AND n = 1
"""

OP9 = f"""
WITH words AS (SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'i', item_id::VARCHAR, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM words),
iw AS (SELECT DISTINCT id AS item, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT id, ws, least(len(ws), 13) AS n, unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) AS i FROM w WHERE kind = 'i' AND len(ws) > 0)),
dw AS (SELECT id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM iw) WHERE kind = 'd' AND len(ws) >= n)),
hits AS (SELECT dw.id, i, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
covered AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT id, i, n FROM hits)) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT w.id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered ON w.id = covered.id LEFT JOIN named ON w.id = named.id WHERE kind = 'd'
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p - 1, 400)) AS k FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 199)) AS p FROM d)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, TRUE) AS opens FROM w SEMI JOIN c USING (k)),
g AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 199 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
x AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS ends, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS head FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(ends, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1,
    "op4_ngram_join": OP4,
    "op6_substring_dedup": OP6,
    "op9_decontamination": OP9,
    "op10_line_dedup": OP10,
}
