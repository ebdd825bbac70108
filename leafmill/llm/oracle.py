"""SQL for the queries that SQL can express, over the whole tables."""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op7_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN row END) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY row""",
    "op6_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_decontaminate": """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS first FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, size, array_to_string(w[first : first + size - 1], ' ') AS gram FROM bi),
sizes AS (SELECT DISTINCT size FROM bg),
di AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS first FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, first, di.size AS size FROM di JOIN bg ON di.size = bg.size AND array_to_string(w[first : first + di.size - 1], ' ') = gram),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(first, first + size)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op10_substring_dedup": """
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, first, array_to_string(w[first : first + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS first FROM dw WHERE len(w) >= 20)),
again AS (SELECT doc_id, first FROM (SELECT doc_id, first, row_number() OVER (PARTITION BY gram ORDER BY doc_id, first) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, first + 20)) AS word FROM again),
each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM dw),
kept AS (SELECT e.doc_id, e.pos, CASE WHEN g.word IS NULL THEN e.word END AS word FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.word),
rest AS (SELECT doc_id, count(*) - count(word) AS n_removed, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM dw LEFT JOIN rest ON dw.doc_id = rest.doc_id""",
    "op8_near_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM c JOIN n p ON c.a = p.doc_id JOIN n q ON c.b = q.doc_id WHERE 100 * common >= 75 * (p.n + q.n - common)),
ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT ways.y, reach.root FROM reach JOIN ways ON reach.doc_id = ways.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id""",
}
