"""DuckDB SQL for the annotation queries, over the shared tables."""

from __future__ import annotations

#: The fixture tables of plans/fixtures.py, as common table expressions.
TABLES = {
    "books": """SELECT doc_id AS book_id, coalesce(text, '') AS text, source AS author FROM documents""",
    "ann": """SELECT e.event_id, b.book_id, 'Book ' || b.book_id AS book_title, b.author,
        CASE WHEN e.event_type IN ('click', 'view') THEN 'highlight' WHEN e.event_type = 'purchase' THEN 'note'
             WHEN e.event_type = 'signup' THEN 'bookmark' ELSE 'last_position' END AS clip_type,
        (e.event_id * 7919) % (length(b.text) + 20) AS char_start,
        CASE WHEN e.event_type IN ('click', 'view')
             THEN (e.event_id * 7919) % (length(b.text) + 20) + CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS BIGINT) END AS char_end,
        CASE WHEN e.event_id % 17 <> 0 THEN strftime(e.ts, '%Y-%m-%d %H:%M:%S') END AS added_date,
        (['yellow', 'pink', 'dark_blue'])[e.user_id % 3 + 1] AS color,
        CASE WHEN e.event_type = 'purchase' THEN 'note ' || e.event_id
             WHEN e.event_type IN ('click', 'view', 'signup') THEN '[' || (['yellow', 'pink', 'dark_blue'])[e.user_id % 3 + 1] || ']' ELSE '' END AS content,
        '/library/' || b.author || '/Book ' || b.book_id || '.sdr/a.yjr' AS source_file,
        '/library/' || b.author || '/Book ' || b.book_id || '.sdr' AS sidecar_dir,
        CASE WHEN e.event_type IN ('click', 'view') THEN 0 WHEN e.event_type = 'signup' THEN 1 WHEN e.event_type = 'purchase' THEN 2 ELSE 3 END AS kind_ord
        FROM events e JOIN books b ON b.book_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents)""",
    "chunks": """SELECT book_id, k AS ordinal, k * 200 AS pid, length(substr(text, k * 200 + 1, 200)) AS length, substr(text, k * 200 + 1, 200) AS text
        FROM (SELECT book_id, text, unnest(range(greatest(CAST(ceil(length(text) / 200) AS BIGINT), 1))) AS k FROM books) WHERE (book_id + k) % 13 <> 0""",
    "pages": """SELECT book_id, k AS ordinal, CASE WHEN k % 9 = 8 THEN 'ix' ELSE CAST(k + 1 AS VARCHAR) END AS label,
        CASE WHEN k % 25 = 24 THEN k * 500 - 500 ELSE k * 500 END AS char_offset
        FROM (SELECT book_id, unnest(range(greatest(CAST(ceil(length(text) / 500) AS BIGINT), 1))) AS k FROM books)""",
    "locations": """SELECT book_id, k + 1 AS location, k * 50 AS char_offset
        FROM (SELECT book_id, unnest(range(greatest(CAST(ceil(length(text) / 50) AS BIGINT), 1))) AS k FROM books)""",
    "gaps": """SELECT *, sum(gap + length(text)) OVER (PARTITION BY book_id ORDER BY pid, ordinal) AS stop FROM (
        SELECT book_id, ordinal, pid, text, greatest(0, pid - lag(pid + length, 1, 0) OVER (PARTITION BY book_id ORDER BY pid, ordinal)) AS gap FROM chunks WHERE text <> '')""",
    "written": """SELECT book_id, CASE WHEN book_id % 4 >= 2 THEN chr(65279) ELSE '' END || text || CASE WHEN book_id % 4 = 2 THEN chr(10) ELSE '' END AS text FROM books WHERE text <> ''""",
    "assembled": """SELECT book_id, string_agg(repeat(' ', gap) || text, '' ORDER BY pid, ordinal) AS text FROM gaps GROUP BY book_id""",
    "paths": """SELECT unnest(
        ['/library/' || coalesce(author, 'none') || '/Book ' || book_id || '.sdr/a.yjr']
        || CASE WHEN book_id % 2 = 0 THEN ['/library/' || coalesce(author, 'none') || '/Book ' || book_id || '.sdr/sub/b.MBP'] ELSE ['/library/' || coalesce(author, 'none') || '/Book ' || book_id || '.apnx'] END
        || CASE WHEN book_id % 5 = 0 THEN ['/library/' || coalesce(author, 'none') || '/Book ' || book_id || '/My Clippings.txt', '/library/' || coalesce(author, 'none') || '/Book ' || book_id || '/notes.txt']
                ELSE ['/library/' || coalesce(author, 'none') || '/Book ' || book_id || '/old clippings.TXT'] END
        || [p.path FOR p IN [{'path': '/library/' || coalesce(author, 'none') || '/Book ' || book_id || s, 'i': i - 1} FOR s, i IN ['.kfx', '.azw3', '.mobi', '.epub', '.azw', '.prc']] IF (book_id + p.i * p.i) % 7 < 2]) AS path FROM books""",
    "paged": """SELECT a.*, (SELECT try_cast(arg_max(p.label, (p.char_offset, p.ordinal)) AS INTEGER) FROM pages p WHERE p.book_id = a.book_id AND p.char_offset <= a.char_start) AS page FROM ann a""",
    "placed": """SELECT a.*,
        greatest((SELECT count(*) FROM locations l WHERE l.book_id = a.book_id AND l.char_offset <= a.char_start), 1) AS location_start,
        CASE WHEN a.char_end IS NOT NULL THEN nullif(greatest((SELECT count(*) FROM locations l WHERE l.book_id = a.book_id AND l.char_offset <= a.char_end), 1),
            greatest((SELECT count(*) FROM locations l WHERE l.book_id = a.book_id AND l.char_offset <= a.char_start), 1)) END AS location_end FROM paged a""",
    "cut_simple": """SELECT a.*, trim(regexp_replace(CASE WHEN (a.content = '' OR a.content[1] = '[') AND char_start < length(b.text)
        THEN substr(b.text, char_start + 1, greatest(0, coalesce(nullif(char_end, 0), char_start) - char_start)) END, '\\s+', ' ', 'g')) AS cut FROM placed a JOIN books b USING (book_id)""",
    "cut": """SELECT a.*, trim(regexp_replace(CASE WHEN (a.content = '' OR a.content[1] = '[') AND char_start < length(b.text)
        THEN substr(b.text, char_start + 1, greatest(0, coalesce(nullif(char_end, 0), char_start) - char_start)) END, '\\s+', ' ', 'g')) AS cut FROM placed a LEFT JOIN assembled b USING (book_id)""",
    "cut_written": """SELECT a.*, trim(regexp_replace(CASE WHEN (a.content = '' OR a.content[1] = '[') AND char_start < length(b.text)
        THEN substr(b.text, char_start + 1, greatest(0, coalesce(nullif(char_end, 0), char_start) - char_start)) END, '\\s+', ' ', 'g')) AS cut FROM placed a LEFT JOIN written b USING (book_id)""",
    "filled": """SELECT * REPLACE (CASE WHEN coalesce(cut, '') <> '' THEN CASE WHEN content = '' THEN cut ELSE content || ' ' || cut END ELSE content END AS content), content AS was FROM cut""",
    "shown": """SELECT *, row_number() OVER (ORDER BY coalesce(added_date, ''), source_file, kind_ord, event_id) AS k FROM placed WHERE clip_type <> 'last_position'""",
    "runs": """SELECT *, sum(CASE WHEN opens_run THEN 1 ELSE 0 END) OVER (ORDER BY k) AS run FROM (SELECT *, coalesce(book_title <> lag(book_title) OVER (ORDER BY k), true) AS opens_run FROM shown)""",
    "run_rows": """SELECT *, first_value(author) OVER (PARTITION BY run ORDER BY k) AS run_author FROM runs""",
}
NEEDS = {
    "ann": ["books"],
    "chunks": ["books"],
    "pages": ["books"],
    "locations": ["books"],
    "written": ["books"],
    "gaps": ["chunks"],
    "assembled": ["gaps"],
    "paths": ["books"],
    "paged": ["ann", "pages"],
    "placed": ["paged", "locations"],
    "cut_simple": ["placed"],
    "cut": ["placed", "assembled"],
    "cut_written": ["placed", "written"],
    "filled": ["cut"],
    "shown": ["placed"],
    "runs": ["shown"],
    "run_rows": ["runs"],
}


def over(*names: str, select: str) -> str:
    """``select`` with the common table expressions that ``names`` stand on."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in NEEDS.get(name, []):
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" + select


EXPORT = "book_title, author, clip_type, page, location_start, location_end, added_date, content, source_file"
_META = """concat_ws(' | ', CASE WHEN page <> 0 THEN 'p. ' || page END,
    CASE WHEN location_start <> 0 THEN 'loc. ' || location_start || CASE WHEN location_end <> 0 THEN '–' || location_end ELSE '' END END, added_date)"""
_LINE = f"""CASE clip_type WHEN 'highlight' THEN '> ' || content || CASE WHEN {_META} <> '' THEN chr(10) || '> *— ' || {_META} || '*' ELSE '' END || chr(10)
    WHEN 'note' THEN '**Note** (' || {_META} || '): ' || content || chr(10)
    ELSE '*Bookmark* (' || {_META} || ')' || CASE WHEN content <> '' THEN ': ' || content ELSE '' END || chr(10) END"""
_ORDER = "coalesce(added_date, ''), source_file, kind_ord, event_id"
_WHERE = """(CASE WHEN page <> 0 THEN 'Page ' || page || '  ' ELSE '' END || CASE WHEN location_start <> 0 THEN 'Loc ' || location_start || CASE WHEN location_end <> 0 THEN '-' || location_end ELSE '' END ELSE '' END
    || CASE WHEN added_date IS NOT NULL THEN '  (' || added_date || ')' ELSE '' END)"""
_BLOCK = f"""CASE WHEN opens_run THEN repeat('=', 60) || chr(10) || book_title || chr(10) || CASE WHEN coalesce(run_author, '') <> '' THEN 'by ' || run_author || chr(10) ELSE '' END || repeat('=', 60) || chr(10) || chr(10) ELSE '' END
    || CASE WHEN {_WHERE} <> '' THEN '[' || upper(clip_type) || '] ' || trim({_WHERE}) || chr(10) ELSE '' END
    || CASE WHEN content <> '' THEN content || chr(10) ELSE '' END"""
_SDR = r"regexp_extract(path, '^(.*/[^/]+\.(?:[sS][dD][rR]))/', 1)"
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1')"
_FORMAT = """CASE WHEN lower(path) LIKE '%/my clippings.txt' THEN 'clippings' WHEN lower(path) LIKE '%.txt' AND lower(regexp_extract(path, '([^/]*)$', 1)) LIKE '%clipping%' THEN 'clippings'
    WHEN lower(path) LIKE '%.yjr' THEN 'yjr' WHEN lower(path) LIKE '%.yjf' THEN 'yjf' WHEN lower(path) LIKE '%.mbp' THEN 'mbp' WHEN lower(path) LIKE '%.apnx' THEN 'apnx' END"""
_NO_POSITION = "clip_type <> 'last_position'"

ORACLES = {
    "resolved_annotations": over("filled", select="SELECT event_id, book_title, author, clip_type, page, location_start, location_end, added_date, content FROM filled"),
    "span_text_simple": over("cut_simple", select="SELECT event_id, CASE WHEN coalesce(cut, '') <> '' THEN CASE WHEN content = '' THEN cut ELSE content || ' ' || cut END ELSE content END AS content FROM cut_simple"),
    "span_text_chunks": over("filled", select="SELECT event_id, content FROM filled"),
    "plain_text_chunks": over(
        "written",
        select="""SELECT book_id, k, k * 300 AS pid, length(substr(text, k * 300 + 1, 300)) AS length, substr(text, k * 300 + 1, 300) AS text
        FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 300) AS BIGINT))) AS k FROM written)""",
    ),
    "span_text_files": over("cut_written", select="SELECT event_id, CASE WHEN coalesce(cut, '') <> '' THEN CASE WHEN content = '' THEN cut ELSE content || ' ' || cut END ELSE content END AS content FROM cut_written"),
    "assembled_text": over("assembled", select="SELECT book_id, text FROM assembled"),
    "chunk_gaps": over("gaps", select='SELECT book_id, ordinal, gap, CAST(stop - length(text) AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end" FROM gaps'),
    "page_asof": over("paged", select="SELECT event_id, page FROM paged"),
    "location_rank": over("placed", select="SELECT event_id, location_start, location_end FROM placed"),
    "page_map_from_nav": over(
        "pages",
        select="""SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY char_offset, ordinal) - 1 AS ordinal, label, char_offset
        FROM pages WHERE ordinal % 10 <> 7 AND ordinal % 12 <> 5""",
    ),
    "clippings_text_parse": over(
        "ann",
        select=f"""SELECT event_id, book_title, CASE WHEN event_id % 6 = 0 THEN '' ELSE author END AS author, clip_type,
        CASE WHEN event_id % 4 = 0 THEN CAST(char_start % 900 + 1 AS INTEGER) END AS page,
        char_start AS location_start, char_end AS location_end, content || ' line ' || event_id AS content,
        '/library/' || author || '/My Clippings.txt' AS source_file FROM ann WHERE {_NO_POSITION}""",
    ),
    "title_author_split": over("ann", select=f"SELECT book_title, CASE WHEN event_id % 6 = 0 THEN '' ELSE author END AS author, count(*) AS n FROM ann WHERE {_NO_POSITION} GROUP BY ALL"),
    "metadata_parse": over(
        "ann",
        select=f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(char_start % 900 + 1 AS INTEGER) END AS page, char_start AS location_start, char_end AS location_end,
        CAST(added_date AS TIMESTAMP) AS added_ts FROM ann WHERE {_NO_POSITION}""",
    ),
    "entry_lines": over(
        "ann", select=f"SELECT event_id, 6 AS n_lines, book_title || CASE WHEN event_id % 6 = 0 THEN '' ELSE ' (' || author || ')' END AS first_line FROM ann WHERE {_NO_POSITION}"
    ),
    "sidecar_decode": over(
        "ann", select=f"SELECT 'a' AS book_title, clip_type, char_start AS location_start, nullif(char_end, char_start) AS location_end, added_date, content, '/library/' || book_title || '.sdr/a.yjr' AS source_file FROM ann WHERE {_NO_POSITION}"
    ),
    "sidecar_nested": over(
        "ann",
        select="""SELECT 'note' AS clip_type, char_start AS location_start, CAST(NULL AS BIGINT) AS location_end, 'see ' AS opening,
        CAST(58 + length(CAST(char_start + 1 AS VARCHAR)) + length(CAST(char_start + 9 AS VARCHAR)) AS INTEGER) AS n_chars, '/library/' || book_title || '.sdr/n.yjr' AS source_file FROM ann WHERE clip_type = 'note'
        UNION ALL SELECT 'highlight', char_start + 1, char_start + 9, '', 0, '/library/' || book_title || '.sdr/n.yjr' FROM ann WHERE clip_type = 'note'""",
    ),
    "sidecar_splits_decode": over(
        "ann",
        select="""SELECT 'note' AS clip_type, char_start AS location_start, CAST(NULL AS BIGINT) AS location_end,
        CAST(58 + length(CAST(char_start + 1 AS VARCHAR)) + length(CAST(char_start + 9 AS VARCHAR)) AS INTEGER) AS n_chars, CAST(NULL AS VARCHAR) AS added_date, book_title || '.sdr/n.yjr' AS source_file FROM ann WHERE clip_type = 'note'
        UNION ALL SELECT 'highlight', char_start + 1, char_start + 9, 0, NULL, book_title || '.sdr/n.yjr' FROM ann WHERE clip_type = 'note'
        UNION ALL SELECT clip_type, char_start, NULL, 0, added_date, book_title || '.sdr/a.yjf' FROM ann WHERE clip_type = 'last_position'""",
    ),
    "last_position_decode": over(
        "ann", select="SELECT 'a' AS book_title, clip_type, char_start AS location_start, CAST(NULL AS BIGINT) AS location_end, added_date, '' AS content, '/library/' || book_title || '.sdr/a.yjf' AS source_file FROM ann WHERE clip_type = 'last_position'"
    ),
    "typed_record_decode": over(
        "ann",
        select="""SELECT 'b' AS book_title, clip_type, char_start AS location_start, CASE WHEN clip_type IN ('highlight', 'note') THEN coalesce(char_end, char_start) END AS location_end,
        CAST(NULL AS VARCHAR) AS added_date, CASE WHEN clip_type IN ('bookmark', 'note') THEN content ELSE '' END AS content, '/library/' || book_title || '.sdr/b.mbp' AS source_file FROM ann WHERE book_id % 7 <> 3""",
    ),
    "page_index_decode": over(
        "pages",
        select="""SELECT 'B' || book_id AS asin, 'g' || (book_id * 7) AS content_guid, count(*) AS page_count, CAST(count(*) AS INTEGER) AS n_offsets, '/library/Book ' || book_id || '.sdr/c.apnx' AS source_file
        FROM pages WHERE book_id % 11 <> 5 GROUP BY book_id""",
    ),
    "page_index_offsets": over("pages", select="SELECT '/library/Book ' || book_id || '.sdr/c.apnx' AS source_file, 'B' || book_id AS asin, CAST(ordinal + 1 AS INTEGER) AS page, char_offset FROM pages WHERE book_id % 11 <> 5"),
    "quarantine": over(
        "ann",
        "pages",
        select="""SELECT DISTINCT '/library/' || book_title || '.sdr/b.mbp' AS source_file, 'mbp' AS format, 'container format' AS reason FROM ann WHERE book_id % 7 = 3
        UNION ALL SELECT DISTINCT '/library/Book ' || book_id || '.sdr/c.apnx', 'apnx', 'page index too short' FROM pages WHERE book_id % 11 = 5""",
    ),
    "corpus_routing": over("paths", select=f"SELECT path, {_FORMAT} AS format FROM paths"),
    "book_title_from_path": over("paths", select=f"SELECT path, CASE WHEN {_SDR} <> '' THEN regexp_extract({_SDR}, '([^/]*)\\.sdr$', 1) ELSE {_STEM} END AS book_title FROM paths"),
    "nearest_sidecar": over("paths", select=f"SELECT path, nullif({_SDR}, '') AS sidecar_dir FROM paths"),
    "book_pairing": over(
        "paths",
        select="""SELECT d.dir, arg_min(p.path, p.rank) AS book_file FROM (SELECT DISTINCT regexp_extract(path, '^(.*)\\.sdr/', 1) AS base, regexp_extract(path, '^(.*\\.sdr)/', 1) AS dir FROM paths WHERE path LIKE '%.yjr') d
        LEFT JOIN (SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS base, list_position(['.kfx', '.azw3', '.mobi', '.epub', '.azw', '.prc'], regexp_extract(path, '(\\.[^./]+)$', 1)) AS rank FROM paths) p
        ON p.base = d.base AND p.rank > 0 GROUP BY d.dir""",
    ),
    "book_override": over("ann", select="SELECT event_id, CASE WHEN event_id % 3 <> 0 AND sidecar_dir IS NOT NULL THEN '/library/one.kfx' END AS book_file FROM ann"),
    "paired_annotations": over(
        "ann",
        "paths",
        select="""SELECT a.event_id, a.sidecar_dir, b.book_file FROM ann a LEFT JOIN (SELECT regexp_replace(path, '\\.[^./]+$', '') || '.sdr' AS dir, arg_min(path, rank) AS book_file
        FROM (SELECT path, list_position(['.kfx', '.azw3', '.mobi', '.epub', '.azw', '.prc'], regexp_extract(path, '(\\.[^./]+)$', 1)) AS rank FROM paths) WHERE rank > 0 GROUP BY ALL) b ON b.dir = a.sidecar_dir""",
    ),
    "union_formats": over(
        "ann",
        select="""SELECT clip_type, format, count(*) AS n, CAST(sum(char_start) AS BIGINT) AS starts FROM (
        SELECT clip_type, CASE WHEN clip_type = 'last_position' THEN 'yjf' ELSE 'yjr' END AS format, char_start FROM ann
        UNION ALL SELECT clip_type, 'mbp', char_start FROM ann WHERE book_id % 7 <> 3) GROUP BY ALL""",
    ),
    "ordered_annotations": over("ann", select=f"SELECT event_id, added_date, source_file AS file_ord, kind_ord, event_id AS rec_ord FROM ann ORDER BY {_ORDER}"),
    "fill_metrics": over(
        "filled",
        select="""SELECT sidecar_dir, count(*) AS n, count(*) FILTER (content <> '' AND NOT content LIKE '%]') - (count(*) - count(*) FILTER (was LIKE '[%')) AS reported,
        count(*) FILTER ((was = '' OR was LIKE '[%') AND content <> was) AS filled FROM filled GROUP BY sidecar_dir""",
    ),
    "page_coverage": over(
        "paged",
        "locations",
        select="""SELECT a.*, m.first_page, m.last_page, l.locations FROM (SELECT book_id, count(*) AS n, count(page) AS paged FROM paged GROUP BY book_id) a
        LEFT JOIN (SELECT book_id, arg_min(label, (char_offset, ordinal)) AS first_page, arg_max(label, (char_offset, ordinal)) AS last_page FROM pages GROUP BY book_id) m USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS locations FROM locations GROUP BY book_id) l USING (book_id)""",
    ),
    "ingest_totals": over("ann", "pages", select="SELECT 'annotations' AS source, count(*) AS n FROM ann UNION ALL SELECT 'page_indexes', count(DISTINCT book_id) FROM pages WHERE book_id % 11 <> 5"),
    "json_pruned": over(
        "placed",
        select="""SELECT '{' || concat_ws(',', '"book_title":"' || book_title || '"', '"author":"' || nullif(author, '') || '"', '"clip_type":"' || clip_type || '"', '"page":' || page, '"location_start":' || location_start,
        '"location_end":' || location_end, '"added_date":"' || added_date || '"', '"content":"' || nullif(content, '') || '"', '"source_file":"' || source_file || '"') || '}' AS json FROM placed""",
    ),
    "csv_rows": over("placed", select=f"SELECT {EXPORT} FROM placed"),
    "markdown_docs": over(
        "placed",
        select=f"""SELECT book_title, coalesce(arg_min(coalesce(added_date, ''), ({_ORDER})), '') AS first_date, '## ' || book_title || CASE WHEN coalesce(min(author), '') <> '' THEN '  ' || chr(10) || '*' || min(author) || '*' ELSE '' END || chr(10)
        || CASE WHEN count(*) FILTER ({_NO_POSITION}) > 0 THEN chr(10) || string_agg({_LINE}, chr(10) ORDER BY {_ORDER}) FILTER ({_NO_POSITION}) ELSE '' END AS document FROM placed GROUP BY book_title""",
    ),
    "text_runs": over("run_rows", select="SELECT event_id, CAST(run AS BIGINT) AS run, opens_run, run_author FROM run_rows"),
    "text_blocks": over("run_rows", select=f"SELECT event_id, CAST(len(string_split({_BLOCK}, chr(10))) AS INTEGER) AS n_lines, {_BLOCK} AS block FROM run_rows"),
    "corpus_flow": over(
        "filled",
        select="""SELECT book_title, '' AS author, clip_type, CASE WHEN book_id % 3 = 1 THEN page END AS page, CASE WHEN book_id % 3 = 1 THEN location_start ELSE char_start END AS location_start,
        CASE WHEN book_id % 3 = 1 THEN location_end ELSE nullif(char_end, char_start) END AS location_end, added_date, CASE WHEN book_id % 3 = 0 THEN was ELSE content END AS content,
        book_title || '.sdr/a.' || CASE WHEN clip_type = 'last_position' THEN 'yjf' ELSE 'yjr' END AS source_file FROM filled
        UNION ALL SELECT book_title, CASE WHEN event_id % 6 = 0 THEN '' ELSE author END, clip_type,
        CASE WHEN event_id % 4 = 0 THEN CAST(char_start % 900 + 1 AS INTEGER) WHEN book_id % 10 = 0 AND book_id % 3 = 1 THEN page END,
        CASE WHEN book_id % 10 = 0 AND book_id % 3 = 1 THEN location_start ELSE char_start END, CASE WHEN book_id % 10 = 0 AND book_id % 3 = 1 THEN location_end ELSE char_end END,
        'Monday, ' || strftime(CAST(added_date AS TIMESTAMP), '%B %-d, %Y %-I:%M:%S %p'),
        CASE WHEN book_id % 10 = 0 AND book_id % 3 <> 0 AND coalesce(cut, '') <> '' THEN content ELSE was || ' line ' || event_id END,
        CASE WHEN book_id % 10 = 0 THEN book_title || '.sdr/My Clippings.txt' ELSE 'clippings ' || book_id || '.txt' END FROM filled WHERE clip_type = 'highlight' AND book_id % 10 < 2""",
    ),
    "corpus_text_books": over(
        "cut_written",
        select=f"""SELECT book_title, clip_type, char_start AS location_start, nullif(char_end, char_start) AS location_end, added_date,
        CASE WHEN book_id % 3 <> 0 AND book_id % 17 <> 7 AND coalesce(cut, '') <> '' THEN CASE WHEN content = '' THEN cut ELSE content || ' ' || cut END ELSE content END AS content, book_title || '.sdr/a.yjr' AS source_file
        FROM cut_written WHERE {_NO_POSITION} UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'unreadable', 'Book ' || book_id || '.txt' FROM written WHERE book_id % 17 = 7""",
    ),
    "corpus_outcomes": over(
        "ann",
        "pages",
        select="""SELECT file, format, CASE WHEN bad THEN 'unreadable' ELSE outcome END AS outcome, CASE WHEN bad OR outcome NOT IN ('annotations', 'page_indexes') THEN 0 ELSE n END AS n FROM (
        SELECT book_title || '.sdr/a.yjr' AS file, 'yjr' AS format, book_id % 19 = 4 AS bad, 'annotations' AS outcome, count(*) AS n FROM ann WHERE clip_type <> 'last_position' GROUP BY book_title, book_id
        UNION ALL SELECT book_title || '.sdr/a.yjf', 'yjf', book_id % 23 = 5, 'annotations', count(*) FROM ann WHERE clip_type = 'last_position' GROUP BY book_title, book_id
        UNION ALL SELECT book_title || '.sdr/b.mbp', 'mbp', false, CASE WHEN book_id % 7 = 3 THEN 'container format' ELSE 'annotations' END, count(*) FROM ann GROUP BY book_title, book_id
        UNION ALL SELECT 'Book ' || book_id || '.sdr/c.apnx', 'apnx', book_id % 29 = 3, CASE WHEN book_id % 11 = 5 THEN 'page index too short' ELSE 'page_indexes' END, count(*) FROM pages GROUP BY book_id
        UNION ALL SELECT CASE WHEN book_id % 10 = 0 THEN book_title || '.sdr/My Clippings.txt' ELSE 'clippings ' || book_id || '.txt' END, 'clippings', book_id % 30 IN (10, 21), 'annotations', count(*)
            FROM ann WHERE clip_type = 'highlight' AND book_id % 10 < 2 GROUP BY book_title, book_id)""",
    ),
    "export_manifest": over("ann", "pages", select="SELECT (SELECT count(*) FROM ann) AS total_clippings, (SELECT count(DISTINCT book_id) FROM pages WHERE book_id % 11 <> 5) AS page_indexes"),
}


def _lines(query: str, column: str) -> str:
    """How often each line stands in the texts of a query, each ended by a line break."""
    return f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split({column}, chr(10))) AS line FROM ({query})) GROUP BY line"


ORACLES["json_sink"] = ORACLES["json_pruned"]
ORACLES["csv_sink"] = f"SELECT * REPLACE (nullif(author, '') AS author, nullif(content, '') AS content) FROM ({ORACLES['csv_rows']})"
ORACLES["markdown_sink"] = _lines(ORACLES["markdown_docs"], "document")
ORACLES["text_sink"] = _lines(ORACLES["text_blocks"], "block")


def _numbered(query: str, column: str, order: str) -> str:
    """(line_no, line): the lines of the texts of a query, counted along ``order``."""
    return f"SELECT row_number() OVER (ORDER BY {order}, i) AS line_no, line FROM (SELECT *, unnest(string_split({column}, chr(10))) AS line, unnest(range(len(string_split({column}, chr(10))))) AS i FROM ({query}))"


_JSON_ROWS = ORACLES["json_pruned"].partition("\nSELECT ")[2].replace(" AS json FROM", f" AS json, {_ORDER.replace('event_id', 'event_id AS e4').replace('source_file', 'source_file AS e2').replace('kind_ord', 'kind_ord AS e3').replace(chr(39) * 2 + ')', chr(39) * 2 + ') AS e1')} FROM")
_MARKDOWN = ORACLES["markdown_docs"].partition("\nSELECT ")[2].replace(" FROM placed GROUP BY", f", min(({_ORDER})) AS first_seen FROM placed GROUP BY").removesuffix(" ")
ORACLES["all_sinks"] = over(
    "run_rows",
    "pages",
    select=f"""SELECT 'json' AS sink, * FROM ({_numbered("SELECT " + _JSON_ROWS, "json", "e1, e2, e3, e4")})
    UNION ALL SELECT 'markdown', * FROM ({_numbered("SELECT " + _MARKDOWN, "document", "first_seen")})
    UNION ALL SELECT 'text', * FROM ({_numbered(f"SELECT k, {_BLOCK} AS block FROM run_rows", "block", "k")})
    UNION ALL SELECT 'manifest', 1, concat_ws(' ', (SELECT count(*) FROM ann), (SELECT count(DISTINCT book_id) FROM pages WHERE book_id % 11 <> 5), (SELECT count(*) FROM ann), (SELECT count(*) FROM ann WHERE {_NO_POSITION}))""",
)
