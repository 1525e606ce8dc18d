"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIXING = f"""
WITH sized AS (
    SELECT doc_id, text, source, len({_WORDS}) AS size, length(coalesce(text, '')) AS n,
        length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols FROM documents),
draws AS (
    SELECT doc_id, source, size,
        -ln((CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
        / (CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(20 AS DOUBLE) * symbols / n) ELSE CAST(1 AS DOUBLE) END) AS key FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM draws GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sources),
weighed AS (SELECT source, source_size, CAST(place % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / CAST(place % 3 + 1 AS DOUBLE) AS full_at FROM placed),
levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
    FROM weighed WINDOW f AS (ORDER BY full_at, weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (SELECT arg_min(level, full_at) AS level, min(full_at) AS full_at FROM levels WHERE level < full_at),
targets AS (SELECT l.source, l.source_size, CASE WHEN r.full_at IS NULL OR l.full_at < r.full_at THEN CAST(l.cap AS DOUBLE) ELSE l.weight * r.level END AS target FROM levels l LEFT JOIN rest r ON true),
summed AS (
    SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 1 END AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM draws d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + CAST(size AS DOUBLE) / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT) >> {shift}) & 31) + 1 AS BIGINT), 1)"
_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([{" || ".join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0))} FOR i IN range(8)], '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""

_NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i + 1:i + 3], ' ') FOR i IN range(len(ws) - 2)]
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sides AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM documents d
LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""

_MINHASH = (
    _NGRAM_JOIN.replace("len(ws) >= 3", "len(ws) >= 2").replace("ws[i + 1:i + 3]", "ws[i + 1:i + 2]").replace("len(ws) - 2)", "len(ws) - 1)").replace("100 * c >= 90", "100 * c >= 80").replace("r.component_id FROM", "r.component_id, d.doc_id = r.component_id AS kept FROM")
)

_NGRAM_LINKS = (
    _NGRAM_JOIN.partition(",\nreach(a, b)")[0]
    + """
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(l.c, 0) AS BIGINT) AS n_links FROM documents d
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS c FROM links GROUP BY a) l ON l.a = d.doc_id"""
)

_LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
marked AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM l),
first AS (SELECT line, min((doc_id, pos)) AS at, length(line) AS n FROM marked WHERE has_word GROUP BY line),
losers AS (SELECT DISTINCT b.line FROM first a JOIN first b ON a.n >= 12 AND b.n >= 12 AND b.n BETWEEN a.n - 1 AND a.n + 1 AND a.at < b.at AND levenshtein(a.line, b.line) = 1),
judged AS (SELECT m.*, NOT has_word OR (f.at = (m.doc_id, m.pos) AND o.line IS NULL) AS stays FROM marked m LEFT JOIN first f ON f.line = m.line LEFT JOIN losers o ON o.line = m.line)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 35], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
repeated AS (SELECT run FROM windows GROUP BY run HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM windows WHERE run IN (SELECT run FROM repeated)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS text, count(*) AS n FROM each e ANTI JOIN covered c ON c.doc_id = e.doc_id AND c.pos = e.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

_FILL_MIDDLE = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT *, len(units) AS n, [CAST('0x' || substr(hex, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM cut),
formed AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM parts"""

#: Per state and initial: the state after it; before a turn nothing, one or two turns may be inserted.
_REPAIR = r"""
WITH RECURSIVE raw AS (
    SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
polynomial(i, v) AS (SELECT i, i FROM range(256) t(i)),
crc_table AS (SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM polynomial),
crcs AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
placed AS (
    SELECT r.*, xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS place FROM raw r, crcs),
hurt AS (
    SELECT conv, turn, CASE WHEN place = 4 THEN 'user' ELSE role END AS role, CASE place WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN place = 3 THEN 2 ELSE 1 END)) FROM placed WHERE place <> 0)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, left(role, 1) AS initial FROM hurt),
faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair FROM numbered),
moves(initial, a, b) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
names(initial, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
inserts(a, b, cost, audit, lines) AS (
    SELECT a, a, 0, '', '' FROM (VALUES (0), (1), (2), (3)) v(a)
    UNION ALL SELECT a, b, 3, 'I', chr(10) || role || ':' FROM moves JOIN names USING (initial)
    UNION ALL SELECT x.a, y.b, 6, 'II', chr(10) || n.role || ':' || chr(10) || o.role || ':' FROM moves x JOIN names n USING (initial) JOIN moves y ON y.a = x.b JOIN names o ON o.initial = y.initial),
edits AS (
    SELECT conv, pos, s.a, s.a AS b, 4 AS cost, 'D' AS audit, '' AS lines FROM faulty, (VALUES (0), (1), (2), (3)) s(a)
    UNION ALL SELECT conv, pos, a, b, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM faulty JOIN moves USING (initial) WHERE fault IN ('', 'truncated')
    UNION ALL SELECT conv, pos, a, b, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || n.role || ':' || text FROM faulty, moves m JOIN names n ON n.initial = m.initial WHERE fault IN ('', 'truncated')),
steps AS (
    SELECT e.conv, e.pos, i.a, e.b, min({'cost': i.cost + e.cost, 'audit': i.audit || e.audit, 'lines': i.lines || e.lines}) AS best FROM edits e JOIN inserts i ON i.b = e.a GROUP BY ALL),
lengths AS (SELECT conv, max(pos) AS n FROM faulty GROUP BY conv),
walk(conv, pos, state, best) AS (
    SELECT conv, CAST(0 AS BIGINT), 0, {'cost': 0, 'audit': '', 'lines': ''} FROM lengths
    UNION ALL SELECT w.conv, s.pos, s.b, min({'cost': w.best.cost + s.best.cost, 'audit': w.best.audit || s.best.audit, 'lines': w.best.lines || s.best.lines})
    FROM walk w JOIN steps s ON s.conv = w.conv AND s.pos = w.pos + 1 AND s.a = w.state GROUP BY w.conv, s.pos, s.b),
ended AS (
    SELECT w.conv, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit, 'lines': w.best.lines || i.lines}) AS best
    FROM walk w JOIN lengths l ON l.conv = w.conv AND l.n = w.pos JOIN inserts i ON i.a = w.state WHERE i.b IN (0, 3) GROUP BY w.conv),
counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv)
SELECT c.conv_id, CAST(coalesce(k.gaps, 0) AS BIGINT) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal,
    CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON k.conv = coalesce(CAST(c.conv_id AS VARCHAR), ' ') LEFT JOIN ended e ON e.conv = k.conv"""

ORACLES: dict[str, str] = {
    "op3_mixing": _MIXING,
    "op5_warc": _WARC,
    "op6_ngram_jaccard_join": _NGRAM_JOIN,
    "ngram_links": _NGRAM_LINKS,
    "op8_line_dedup": _LINE_DEDUP,
    "op9_substring_dedup": _SUBSTRING_DEDUP,
    "op11_conversation_repair": _REPAIR,
    "op12_minhash": _MINHASH,
    "op13_fill_middle": _FILL_MIDDLE,
}
