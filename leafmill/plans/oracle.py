"""SQL beside the queries of plans/queries.py, for DuckDB; written from the rules, not from the Spark plans. Of the engine it
takes the long prompt texts alone; all other values stand here once more."""

from __future__ import annotations

from leafmill.functions import prompts as P

# Fixed values from here.
WHITE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_CLASS = "".join(f"\\x{{{c:X}}}" for c in WHITE)
ENDS = "。！？；?!.．)]】」』\"'`"
OPENS = rf"^(#{{1,6}}[{WHITE_CLASS}]|[*+-][{WHITE_CLASS}]|\p{{Nd}}+\.[{WHITE_CLASS}]|>[{WHITE_CLASS}]|```|\|[{WHITE_CLASS}])"
CELL = rf"[{WHITE_CLASS}]*:?--+:?[{WHITE_CLASS}]*"
HEADER_RULE = rf"^\|?{CELL}(\|{CELL})+\|?$"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2F800}-\x{2FA1F}"
THIRDS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}"
CUT_MARK = "[…summary truncated to fit context window]"
SENTINEL_HEAD = "(vision model unavailable for page"
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
CEILING, UNKNOWN_LIMIT, N_FIELDS = 1_048_576, 128_000, 6
KNOWN = {
    "MiniMax-M3": 524_288, "MiniMax-Text-01": 1_000_000, "MiniMax-VL-01": 524_288, "gpt-4o": 128_000, "gpt-4o-mini": 128_000,
    "gpt-4-turbo": 128_000, "claude-3-5-sonnet-latest": 200_000, "claude-3-opus-latest": 200_000,
}
# Fixed values end.


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


SPACES = "(" + " || ".join(f"chr({c})" for c in WHITE) + ")"
NL, NL2 = "chr(10)", "(chr(10) || chr(10))"
SINGLE = "SELECT doc_id, CAST(n + 1 AS INTEGER) AS page_number, substr(text, n * 400 + 1, 400) AS markdown FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 399) // 400)) AS n FROM documents WHERE length(text) > 0)"
DOUBLE = SINGLE.replace("SELECT doc_id, text, unnest", "SELECT doc_id, text, unnest").replace("FROM documents WHERE", f"FROM (SELECT doc_id, replace(text, {NL}, {NL2}) AS text FROM documents) WHERE")
TABLED = f"""SELECT doc_id, page_number,
  CASE WHEN page_number % 7 = 2 THEN '| h | k |' || {NL} || '|---|---|' || {NL} || '| a | b |' || {NL} WHEN page_number % 7 = 4 THEN '- item ' WHEN page_number % 11 = 5 THEN '中文' ELSE '' END
  || markdown ||
  CASE WHEN page_number % 7 = 1 THEN {NL2} || '| x | y' WHEN page_number % 11 = 4 THEN '中' WHEN page_number % 13 = 6 THEN {NL2} || '# Head' WHEN page_number % 5 = 3 THEN ' (' ELSE '' END AS markdown
FROM ({DOUBLE})"""


def blocks(column: str) -> str:
    return f"list_filter(list_transform(string_split_regex(trim({column}, {SPACES}), {q(f'{chr(92)}n[{WHITE_CLASS}]*{chr(92)}n')}), lambda x: trim(x, {NL})), lambda x: trim(x, {SPACES}) <> '')"


def folded(source: str, compat: bool) -> str:
    """CTEs that go through each document's pages with the text so far; `fold` has a row for each page."""
    separator = q(HEADER_RULE)
    tail = f"list_extract(string_split(rtrim(f.buf, {SPACES}), {NL}), -1)"
    lost = "f.out" if compat else "list_append(f.out, joined)"
    return f"""
WITH RECURSIVE pages AS ({source}),
numbered AS (SELECT doc_id, page_number, b, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS k FROM (SELECT doc_id, page_number, {blocks('markdown')} AS b FROM pages) WHERE len(b) > 0),
fold AS (
  SELECT doc_id, page_number, k, list_extract(b, -1) AS buf, CAST(b[1 : len(b) - 1] AS VARCHAR[]) AS out, 'first' AS kind FROM numbered WHERE k = 1
  UNION ALL
  SELECT doc_id, page_number, k,
    CASE WHEN kind = 'new' OR len(b) > 1 THEN list_extract(b, -1) ELSE joined END,
    CASE WHEN kind = 'new' THEN list_concat(list_append(out, buf), b[1 : len(b) - 1]) WHEN len(b) > 1 THEN list_concat({lost.replace('f.', '')}, b[2 : len(b) - 1]) ELSE out END, kind
  FROM (SELECT *, CASE kind WHEN 'table' THEN rtrim(buf, {SPACES}) || ' |' || {NL} || ltrim(
          CASE WHEN len(string_split(b[1], {NL})) >= 3 AND regexp_matches(trim(list_extract(string_split(b[1], {NL}), 2), {SPACES}), {separator})
               THEN array_to_string(string_split(b[1], {NL})[3 :], {NL}) ELSE b[1] END, {SPACES})
        ELSE rtrim(buf, {SPACES}) || CASE WHEN regexp_matches(right(rtrim(buf, {SPACES}), 1), '[(\\[{{「『【《{HAN}]') OR regexp_matches(left(b[1], 1), '[{HAN}]') THEN '' ELSE ' ' END || b[1] END AS joined
    FROM (SELECT f.doc_id, n.page_number, n.k, f.buf, f.out, n.b,
            CASE WHEN left(ltrim({tail}, {SPACES}), 1) = '#' THEN 'new'
                 WHEN left(ltrim({tail}, {SPACES}), 1) = '|' AND right({tail}, 1) <> '|' THEN 'table'
                 WHEN ({tail} <> '' AND contains({q(ENDS)}, right({tail}, 1))) OR regexp_matches(list_extract(string_split(n.b[1], {NL}), 1), {q(OPENS)}) THEN 'new' ELSE 'text' END AS kind
          FROM fold f JOIN numbered n ON f.doc_id = n.doc_id AND n.k = f.k + 1)))"""


def stitched(source: str, compat: bool = False) -> str:
    return f"""{folded(source, compat)},
ends AS (SELECT doc_id, array_to_string(list_append(out, buf), {NL2}) AS markdown FROM fold WHERE (doc_id, k) IN (SELECT doc_id, max(k) FROM numbered GROUP BY doc_id))
SELECT p.doc_id, coalesce(markdown, '') AS markdown, length(coalesce(markdown, '')) AS n_chars, n_pages
FROM (SELECT doc_id, count(*) AS n_pages FROM pages GROUP BY doc_id) p LEFT JOIN ends ON p.doc_id = ends.doc_id"""


def tokens(column: str) -> str:
    cjk = f"(length({column}) - length(regexp_replace({column}, '[{THIRDS}]', '', 'g')))"
    return f"CAST(ceil({cjk} / 3.0) + ceil((length({column}) - {cjk}) / 4.0) AS BIGINT)"


IMAGE = "(CASE WHEN doc_id % 10 <> 3 THEN n_chars * 97 + doc_id * 1013 END)"


def image_tokens(size: str) -> str:
    return f"greatest(1, CAST(ceil(((({size}) + 2) // 3 * 4) / CAST(3.5 AS DOUBLE)) AS BIGINT))"


def shrunk(size: str, side: str, target: str) -> str:
    ratio = f"pow(CAST({target} AS DOUBLE) / CAST({side} AS DOUBLE), 2)"
    return f"(CASE WHEN {side} <= 0 OR {size} <= 0 THEN {size} ELSE greatest(1024, CAST(trunc({size} * {ratio}) AS BIGINT)) END)"


def side(size: str) -> str:
    return f"(CASE WHEN {size} <= 0 THEN 256 ELSE greatest(256, CAST(trunc(2 * sqrt(CAST({size} AS DOUBLE))) AS INTEGER)) END)"


BUDGET = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, CAST(floor((20000 + doc_id * 31) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS lim, 120 + n_chars AS txt, coalesce({IMAGE}, 0) AS size,
    CAST(coalesce(greatest(1000 + doc_id % 1700, CASE WHEN doc_id % 9 <> 4 THEN 300 + (doc_id * 7) % 2300 END), 0) AS INTEGER) AS side FROM documents),
costed AS (SELECT *, CASE WHEN size > 0 THEN {image_tokens('size')} ELSE 0 END AS tok, greatest(0, lim - txt) AS room FROM given),
search AS (
  SELECT doc_id, size, side, room, 768 AS low, side AS high, 0 AS step FROM costed WHERE tok > room AND side > 768
  UNION ALL
  SELECT doc_id, size, side, room, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid END, step + 1
  FROM (SELECT *, {image_tokens(shrunk('size', 'side', 'mid'))} <= room AS fits FROM (SELECT *, (low + high) // 2 AS mid FROM search WHERE high - low > 4))),
best AS (SELECT doc_id, low AS best FROM search WHERE high - low <= 4),
priced AS (SELECT c.*, best, {image_tokens(shrunk('size', 'side', 'best'))} AS small FROM costed c LEFT JOIN best b ON c.doc_id = b.doc_id)
SELECT doc_id, CAST(txt + CASE WHEN tok <= room OR side <= 768 THEN tok ELSE small END AS BIGINT) AS total, lim AS "limit",
  CASE WHEN tok <= room THEN true WHEN side <= 768 THEN false ELSE txt + small <= lim END AS fits,
  CAST(CASE WHEN tok <= room THEN 1536 WHEN side <= 768 THEN side ELSE best END AS INTEGER) AS needed_long_side,
  CASE WHEN tok <= room THEN 'image fits within budget at original size' WHEN side <= 768 THEN 'image already smaller than min_long_side=768; fixed-text budget is too tight'
       ELSE 'downscaled from ' || side || 'px to ' || best || 'px to fit budget=' || room || ' image tokens' END AS reason
FROM priced"""

MOST = "(doc_id % 997 - 3)"
MARK = len(CUT_MARK) + 2


def cut_summary(text: str, most: str) -> str:
    head, tail = f"(({most} - {MARK}) // 2)", f"({most} - {MARK} - ({most} - {MARK}) // 2)"
    last = f"CASE WHEN {tail} > 0 THEN ltrim(right({text}, {tail}), {SPACES}) ELSE '' END"
    return f"""CASE WHEN {most} <= 0 OR length({text}) <= {most} THEN {text} WHEN {most} < {MARK} THEN left({text}, {most})
  ELSE rtrim(left({text}, {head}), {SPACES}) || {NL} || {q(CUT_MARK)} || CASE WHEN {last} <> '' THEN {NL} || {last} ELSE '' END END"""


def fallback(layer: str) -> str:
    return f"""CASE WHEN trim({layer}, {SPACES}) = '' THEN '*(vision model unavailable and PDF text layer is empty for this page — no content recovered)*'
  ELSE '*(vision model unavailable — falling back to PDF text layer; tables, figures, and layout are NOT preserved)*' || {NL2} || '```' || {NL} || trim({layer}, {SPACES}) || {NL} || '```' || {NL} END"""


SENTINEL = f"(printf('(vision model unavailable for page %d; text-layer fallback emitted; treat as sentinel — no extractor payload available)', page_number) || {NL})"
SPEC_ROWS = """SELECT doc_id, CAST(page AS INTEGER) AS page, min(pos) AS pos FROM (
  SELECT doc_id, unnest(named) AS page, generate_subscripts(named, 1) AS pos FROM (
    SELECT doc_id, list_concat(list_concat(range(2, 3 + 2 + doc_id % 4 - 2), [CAST(1 AS BIGINT)]), range(1 + doc_id % 6, 5 + doc_id % 6)) AS named FROM documents)) GROUP BY doc_id, page"""
SPEC_SEMI = f"SELECT p.doc_id, p.page_number, p.markdown FROM ({SINGLE}) p JOIN ({SPEC_ROWS}) s ON p.doc_id = s.doc_id AND p.page_number = s.page WHERE p.doc_id % 3 <> 0"
CACHED = f"""SELECT doc_id, page_number, CASE WHEN m % 11 = 0 THEN {SENTINEL} WHEN m % 7 <> 1 THEN markdown END AS extract_text, CASE WHEN m % 6 <> 2 THEN markdown END AS format_markdown, CASE WHEN m % 11 = 0 THEN 'fallback' ELSE 'ok' END AS status
FROM (SELECT *, doc_id + page_number AS m FROM ({SINGLE})) WHERE m % 5 <> 0"""
REAL = f"coalesce(length(extract_text) > 0 AND NOT starts_with(ltrim(left(extract_text, 128), {SPACES}), {q(SENTINEL_HEAD)}), false)"


def known(model: str) -> str:
    return f"CASE {model} {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in KNOWN.items())} ELSE {UNKNOWN_LIMIT} END"


def reason(name: str, test: str, old: str, new: str) -> str:
    return f"CASE WHEN {test} THEN ['{name} changed: cached=' || {old} || ', current=' || {new}] ELSE [] END"


PAGES_OLD = "CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE '[1, ' || (2 + doc_id % 3) || ']' END"
DRIFT = f"""SELECT doc_id, array_to_string(r, '; ') AS reasons, len(r) AS n FROM (SELECT doc_id, list_concat(list_concat(list_concat(list_concat(list_concat(
  {reason('pdf', 'doc_id % 13 = 1', "'''/in/' || doc_id || '.pdf'''", "'''/other.pdf'''")},
  {reason('dpi', 'doc_id % 7 = 2', "'144'", "'200'")}),
  {reason('with_summary', 'doc_id % 11 = 3', "'True'", "'False'")}),
  {reason('pages', 'doc_id % 5 = 4', PAGES_OLD, "'[3, 9]'")}),
  {reason('model', 'doc_id % 17 = 5', "'''m'''", "'''n'''")}),
  {reason('persona_version', 'doc_id % 19 = 6', "'''v1'''", "'''v2'''")}) AS r FROM documents)"""

PROMPT_SUMMARY = "(CASE WHEN page_number % 3 <> 1 THEN markdown ELSE '' END)"


def prompt_extract() -> str:
    cut = cut_summary(PROMPT_SUMMARY, "100")
    hint = "(CASE WHEN page_number % 4 <> 2 THEN markdown ELSE '' END)"
    return f"""CASE WHEN trim({cut}, {SPACES}) = '' THEN '' ELSE 'Running summary of preceding pages:' || {NL} || ({cut}) || {NL2} END
 || CASE WHEN trim({hint}, {SPACES}) = '' THEN '' ELSE {q(P.HINT)} || trim({hint}, {SPACES}) || {NL} || '```' || {NL2} END
 || printf('Call your add_image tool with image_url=`page_%04d.png` to attach the rendered page image, then transcribe its full content into raw markdown.', page_number) || {NL2} || {q(P.RULES)}"""


WAITS = """SELECT doc_id, CAST(i - 1 AS INTEGER) AS attempt, greatest(0.0, least(CAST(1.0 + doc_id % 3 AS DOUBLE) * [1, 1, 2, 3, 5, 8, 13, 21, 34][i] * (1 + CAST(0.25 AS DOUBLE) * ((doc_id % 5 - 2) / CAST(2.0 AS DOUBLE))), CAST(5.0 + doc_id % 50 AS DOUBLE))) AS seconds
FROM (SELECT doc_id, unnest(range(1, 1 + doc_id % 9)) AS i FROM documents)"""

LIMITS = f"""
WITH entries AS (SELECT pos, lower(id) AS id, least(v, {CEILING}) AS lim FROM (
  SELECT p_partkey AS pos, 'Model-' || (p_partkey % 60) || CASE WHEN p_partkey % 3 = 1 THEN '-snapshot' ELSE '' END AS id,
    coalesce({', '.join(f"CASE WHEN p_partkey % 5 = {i - 1} AND p_partkey * 9000 * {i % 3} > 0 THEN p_partkey * 9000 * {i % 3} END" for i in range(N_FIELDS))}) AS v
  FROM part) WHERE v IS NOT NULL),
models AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'gpt-4-turbo' WHEN doc_id % 9 = 1 THEN 'nobody' ELSE 'model-' || (doc_id % 90) END AS model, CASE WHEN doc_id % 31 = 7 THEN 5000 END AS forced FROM documents),
probed AS (SELECT model, lim FROM (SELECT m.model, lim, row_number() OVER (PARTITION BY m.model ORDER BY id <> lower(m.model), pos) AS n FROM (SELECT DISTINCT model FROM models) m JOIN entries ON contains(id, lower(m.model))) WHERE n = 1)
SELECT doc_id, m.model, CAST(coalesce(forced, lim, {known('m.model')}) AS BIGINT) AS ctx_limit FROM models m LEFT JOIN probed p ON m.model = p.model"""

RESULTS = f"SELECT doc_id, page_number, markdown, CASE WHEN (doc_id * 3 + page_number) % 8 = 1 THEN 'fallback' ELSE 'ok' END AS status, ((doc_id * 3 + page_number) % 100) / CAST(8 AS DOUBLE) AS elapsed FROM ({SINGLE})"
TAIL = "CASE WHEN doc_id % 4 = 1 THEN '..' ELSE '' END"
WHOLE, STEM = f"(replace(text, '/', '_') || {TAIL})", f"(CASE WHEN doc_id % 7 <> 3 THEN source || '. ' || doc_id ELSE '' END || {TAIL})"
PERSONAS = " || chr(0) || ".join(q(x) for x in P.PERSONAS)

ORACLE = {
    "page_split": SINGLE,
    "stitch_off": f"SELECT doc_id, string_agg(markdown, {NL2} || '---' || {NL2} ORDER BY page_number) AS markdown, length(string_agg(markdown, {NL2} || '---' || {NL2} ORDER BY page_number)) AS n_chars, count(*) AS n_pages FROM ({SINGLE}) GROUP BY doc_id",
    "stitch_heuristic": stitched(DOUBLE),
    "stitch_unbroken": stitched(SINGLE),
    "stitch_tables": stitched(TABLED),
    "stitch_compat": stitched(TABLED, compat=True),
    "block_split": f"SELECT doc_id, page_number, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS position, unnest(b) AS block FROM (SELECT doc_id, page_number, {blocks('markdown')} AS b FROM ({DOUBLE}))",
    "boundary_decision": f"{folded(TABLED, False)} SELECT doc_id, page_number, kind FROM fold",
    "text_tokens": f"SELECT doc_id, page_number, {tokens('markdown')} AS tokens FROM ({TABLED})",
    "image_tokens": f"SELECT doc_id, CASE WHEN {IMAGE} IS NULL THEN 0 ELSE {image_tokens(IMAGE)} END AS tokens, CASE WHEN {IMAGE} IS NULL THEN NULL ELSE {shrunk(IMAGE, '2000', '(doc_id % 2000)')} END AS shrunk, CASE WHEN {IMAGE} IS NULL THEN NULL ELSE {side(IMAGE)} END AS side FROM documents",
    "budget_plan": f"SELECT *, NOT fits OR needed_long_side < 1536 AS resize, least(needed_long_side, 1536) AS side FROM ({BUDGET})",
    "strip_think": f"SELECT doc_id, trim(regexp_replace(' 　' || left(text, 60) || '<think>a' || {NL} || 'b</think>' || substr(text, 61) || '<think></think> ' || {NL} || CASE WHEN doc_id % 3 = 0 THEN '<think>open' ELSE '' END, '(?s)<think>.*?</think>', '', 'g'), {SPACES}) AS text FROM documents",
    "truncate_summary": f"SELECT doc_id, {cut_summary('text', MOST)} AS summary FROM documents",
    "text_fallback": f"SELECT doc_id, page_number, {fallback('layer')} AS markdown, {SENTINEL} AS extract_text FROM (SELECT doc_id, page_number, CASE WHEN page_number % 4 = 0 THEN ' ' || {NL} || '　 ' ELSE markdown END AS layer FROM ({SINGLE}))",
    "page_spec": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS position, page FROM ({SPEC_ROWS})",
    "page_spec_semi": SPEC_SEMI,
    "pages_out_of_range": f"SELECT s.doc_id, min(s.page) AS first_bad_page FROM ({SPEC_ROWS}) s JOIN (SELECT doc_id, max(page_number) AS total FROM ({SINGLE}) GROUP BY doc_id) t ON s.doc_id = t.doc_id WHERE s.page > t.total GROUP BY s.doc_id",
    "missing_pages_anti": f"SELECT doc_id, page_number FROM ({SINGLE}) WHERE (doc_id + page_number) % 5 = 0",
    "page_union": f"SELECT doc_id, page_number, CASE WHEN (doc_id + page_number) % 5 = 0 THEN 'render' ELSE 'cache' END AS source FROM ({SINGLE})",
    "resume_route": f"""SELECT p.doc_id, p.page_number,
  CASE WHEN extract_text IS NOT NULL AND format_markdown IS NOT NULL AND status <> 'fallback' THEN 'cached' WHEN {REAL} THEN 'reformat' ELSE 'full' END AS route,
  CASE WHEN extract_text IS NOT NULL AND format_markdown IS NOT NULL THEN 'cached' ELSE 'full' END AS route_keeping_fallbacks, {REAL} AS has_extract
FROM ({SINGLE}) p LEFT JOIN ({CACHED}) c ON p.doc_id = c.doc_id AND p.page_number = c.page_number""",
    "fingerprint_drift": DRIFT,
    "meta_round_trip": """SELECT doc_id, CASE WHEN ok THEN '/in/' || doc_id || '.pdf' END AS pdf, CASE WHEN ok THEN 144 END AS dpi, CASE WHEN ok THEN true END AS with_summary, CASE WHEN ok AND doc_id % 4 <> 0 THEN 2 END AS n_pages, CASE WHEN ok THEN 'm' END AS model, NOT ok AS rejected
FROM (SELECT doc_id, doc_id % 6 < 4 AS ok FROM documents)""",
    "prompt_build": f"""SELECT doc_id, page_number, {prompt_extract()} AS extract, {q(P.REFORMAT)} || markdown || {NL} || '```' AS reformat,
  CASE WHEN trim({PROMPT_SUMMARY}, {SPACES}) = '' THEN {q(P.FIRST_PAGE)} ELSE 'Previous running summary:' || {NL} || {PROMPT_SUMMARY} || {NL2} END || {q(P.SUMMARIZE % 500)} AS summarize FROM ({SINGLE})""",
    "retry_schedule": WAITS,
    "error_kinds": """SELECT doc_id, doc_id % 7 < 2 OR status >= 500 OR status = 429 AS transient, CASE WHEN doc_id % 7 < 2 THEN 'Error: m' || doc_id ELSE 'Error: status=' || status || ': m' || doc_id END AS summary
FROM (SELECT doc_id, 400 + (doc_id * 13) % 150 AS status FROM documents)""",
    "ctx_limit_resolve": LIMITS,
    "run_metrics": f"SELECT doc_id, count(*) AS n_pages, sum(elapsed) AS total_s, sum(elapsed) / count(*) AS avg_s, count(*) FILTER (WHERE status = 'fallback') AS n_fallback, CAST(sum(length(markdown)) AS BIGINT) AS n_chars FROM ({RESULTS}) GROUP BY doc_id",
    "fallback_pages": f"SELECT doc_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages, count(*) AS n FROM ({RESULTS}) WHERE status = 'fallback' GROUP BY doc_id",
    "page_ordinals": f"SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM ({SPEC_SEMI})",
    "cache_key": f"""SELECT doc_id, CASE WHEN length(safe) BETWEEN 1 AND 60 AND NOT contains(stem, '\\') THEN safe ELSE left(sha256(path), 16) END AS key,
  CASE WHEN length(all_safe) BETWEEN 1 AND 60 AND NOT contains(all_stem, '\\') THEN all_safe ELSE left(sha256(all_path), 16) END AS whole,
  CASE WHEN doc_id % 5 = 2 THEN 'com1_' WHEN upper(safe) IN ({', '.join(map(q, RESERVED))}) THEN safe || '_' ELSE safe END AS stem,
  CASE WHEN upper(safe) IN ({', '.join(map(q, RESERVED))}) THEN safe || '_' ELSE safe END || '-' || left(sha256(path), 12) AS name
FROM (SELECT *, '/in/' || {STEM} || '.pdf' AS path, '/in/' || {WHOLE} || '.pdf' AS all_path, CASE WHEN rtrim(stem, ' .') = '' THEN '_' ELSE rtrim(stem, ' .') END AS safe, CASE WHEN rtrim(all_stem, ' .') = '' THEN '_' ELSE rtrim(all_stem, ' .') END AS all_safe
FROM (SELECT doc_id, text, source, CASE WHEN {STEM} = '' THEN '.pdf' ELSE {STEM} END AS stem, CASE WHEN {WHOLE} = '' THEN '.pdf' ELSE {WHOLE} END AS all_stem FROM documents))""",
    "artifact_paths": f"SELECT doc_id, page_number, {', '.join(f'''printf('/c/%d/page_%04d{suffix}', doc_id, page_number + 9990) AS {name}''' for name, suffix in (('png', '.png'), ('text', '_text.txt'), ('resized', '_resized.jpg'), ('extract', '_extract.txt'), ('format', '_format.md')))} FROM ({SINGLE})".replace('AS text', 'AS "text"').replace('AS format', 'AS "format"').replace("AS extract", 'AS "extract"'),
    "data_url": """SELECT doc_id, 'data:image/jpeg;base64,' || b AS url, CASE WHEN s IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'look' ELSE '(could not inline image at ' || u || ')' END WHEN doc_id % 2 = 0 THEN 'look' || chr(10) || s ELSE s END AS reference
FROM (SELECT *, CASE WHEN doc_id % 5 = 3 THEN 'VISION_IMAGE:image/png:AAAA' WHEN doc_id % 5 <> 2 THEN 'VISION_IMAGE:image/jpeg:' || b END AS s
FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 1 THEN to_base64(encode(text)) END AS b, CASE WHEN doc_id % 5 = 2 THEN 'https://x/y.png' WHEN doc_id % 5 = 3 THEN 'data' ELSE '/p/' || doc_id END AS u FROM documents))""",
    "persona_version": f"SELECT DISTINCT source, left(sha256({PERSONAS}), 16) AS version, left(sha256({PERSONAS} || chr(0) || source), 16) AS changed, {q(P.SUMMARIZER.partition(chr(10) * 2)[2])} AS backstory FROM documents",
    "model_stages": f"SELECT doc_id, page_number, trim(markdown, {SPACES}) AS markdown, trim(markdown, {SPACES}) AS extract_text, 'ok' AS status, 2 AS attempts FROM ({SINGLE})",
    "model_summary": f"SELECT doc_id, page_number, m AS markdown, {cut_summary('m', '150')} AS summary, 'ok' AS status, 3 AS attempts FROM (SELECT doc_id, page_number, trim(markdown, {SPACES}) AS m FROM ({SINGLE}))",
    "model_reformat": f"SELECT doc_id, page_number, trim(markdown, {SPACES}) AS markdown, markdown AS extract_text, 'ok' AS status, 1 AS attempts FROM ({SINGLE})",
    "model_retries": f"""SELECT doc_id, page_number, CASE status WHEN 'ok' THEN trim(markdown, {SPACES}) WHEN 'fallback' THEN {fallback('markdown')} END AS markdown,
  CASE status WHEN 'ok' THEN trim(markdown, {SPACES}) WHEN 'fallback' THEN {SENTINEL} END AS extract_text, status, CASE WHEN status = 'ok' THEN page_number % 4 + 2 WHEN error LIKE '%busy' THEN 3 ELSE 1 END AS attempts,
  error, CASE WHEN error LIKE 'Malformed%' THEN 2 ELSE 0 END AS malformed
FROM (SELECT *, CASE WHEN page_number % 11 = 7 THEN 'failed' WHEN page_number % 13 = 9 OR page_number % 4 = 3 THEN 'fallback' ELSE 'ok' END AS status,
  CASE WHEN page_number % 11 = 7 THEN 'ModelError: status=400: refused' WHEN page_number % 13 = 9 THEN 'MalformedOutput: 2 fault(s): bad' WHEN page_number % 4 = 3 THEN 'ModelError: status=503: busy' END AS error FROM ({SINGLE}))""",
    "convert_failures": f"""SELECT doc_id, CASE WHEN count(fault) = 0 THEN string_agg(markdown, {NL2} || '---' || {NL2} ORDER BY page_number) END AS markdown,
  CASE WHEN count(fault) = 0 THEN length(string_agg(markdown, {NL2} || '---' || {NL2} ORDER BY page_number)) END AS n_chars, count(*) AS n_pages,
  coalesce(string_agg(CASE WHEN fault IS NOT NULL THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS failed_pages, arg_min(fault, page_number) FILTER (WHERE fault IS NOT NULL) AS error
FROM (SELECT *, CASE WHEN (doc_id * 5 + page_number) % 41 = 0 THEN 'no result' WHEN (doc_id * 5 + page_number) % 29 = 1 THEN 'E' || page_number END AS fault FROM ({SINGLE})) GROUP BY doc_id""",
    "stitch_stream": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, markdown FROM ({stitched(DOUBLE)}) WHERE markdown <> ''",
    "pdf_magic": "SELECT doc_id, doc_id % 4 = 1 OR (doc_id % 4 = 0 AND starts_with(coalesce(text, ''), '%PDF-')) AS is_pdf FROM documents",
    "summary_read": "SELECT doc_id, doc_id % 5 IN (3, 4) AS corrupt, CASE WHEN doc_id % 5 = 2 THEN coalesce(text, '') ELSE '' END AS summary FROM documents",
    "store_latest": f"SELECT doc_id, page_number, CASE WHEN page_number % 3 = 0 THEN 'new ' ELSE '' END || markdown AS markdown FROM ({SINGLE}) WHERE page_number % 5 <> 0",
    "cached_images": f"""SELECT doc_id, page_number, m % 4 <> 0 AND (page_number % 3 = 0 OR m % 2 = 1) AS render, m % 4 <> 0 AND (page_number % 5 = 0 OR m % 3 = 1) AS resize
FROM (SELECT *, doc_id + page_number AS m FROM ({SINGLE}))""",
}
