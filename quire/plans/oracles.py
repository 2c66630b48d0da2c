"""The same results in DuckDB's SQL, written on their own: windows over whole books where the operators use two levels."""

from __future__ import annotations

WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def strip(x: str) -> str:
    return f"trim(coalesce({x},''), {WS})"


def norm(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '\s+', ' ', 'g')"


def fold(x: str) -> str:
    """Letters beyond ASCII as underscores, so that word boundaries fall where they do in Unicode-aware engines."""
    return rf"regexp_replace(coalesce({x},''), '[^\x00-\x7F\p{{P}}\p{{Z}}\p{{S}}\p{{C}}]', '_', 'g')"


def found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group})"


B = "b AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY loaded_at DESC) = 1)"
E = "e AS (SELECT * FROM extracted_blocks QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY loaded_at DESC) = 1)"
O = "o AS (SELECT * FROM ocr_blocks QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY loaded_at DESC) = 1)"
T = "t AS (SELECT * FROM translation_memory QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC) = 1)"
J = "j AS (SELECT job.job_id AS id, job.book_id AS book_id, job.template_id AS template_id, lower(job.source_language) AS src, lower(job.target_language) AS tgt, payload.chapter_id AS chapter_id, payload.chunk_id AS chunk_id, payload.source_text AS text, payload.block_ids AS block_ids, payload, profile_name FROM job_inputs QUALIFY row_number() OVER (PARTITION BY job.job_id ORDER BY loaded_at DESC) = 1)"
A = "a AS (SELECT *, job_id AS id FROM job_outputs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY loaded_at DESC) = 1)"
P = f"{J}, {A}, p AS (SELECT j.id, j.text AS source_text, a.translated_text AS target_text FROM j LEFT JOIN a ON j.id = a.id)"

NUMBER = r"\b\d+(?:[.,]\d+)?\b"
LINK = r"(?i)\b(?:https?://\S+|www\.\S+)\b"
DATES = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b",
]
EQUATION = r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[^,;\n]{1,64}"
ACRONYM = r"\b[A-Z]{2,}\b"
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
COMMON = "'about','after','before','because','between','chapter','example','general','information','language','method','number','people','process','result','section','system','theory','through','without'"
NOTE_BODY = r"^\s*(?:\[?\d{1,3}\]?|\d{1,3}[.)])\s+\S+"
NOTE_MARKER = r"^\s*(?:\[\d{1,3}\]|\d{1,3})\s*$"
CAPTION = r"(?i)^(?:figure|fig\.?|table|image|photo)\s*\d*\s*[:.\-)]\s+"


def joined(x: str, sep: str = ";") -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '{sep}')"


def distinct_folded(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position(list_transform({x}, lambda v: lower(v)), lower(w)) = i)"


def hints(x: str) -> str:
    return f"list_concat({found(x, ACRONYM)}, {found(x, NAME)})"


def lists(x: str) -> str:
    rows = f"list_filter(list_transform(regexp_split_to_array(coalesce({x},''), '\\r\\n|[\\n\\r]'), lambda v: trim(v, {WS})), lambda v: v <> '')"
    item = r"^(?:[-*•] |\d+[.)]\s+)"
    return f"CASE WHEN len({rows}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({rows}, lambda v: regexp_matches(v, '{item}')))::DOUBLE / len({rows}) END"


def share(x: str, pattern: str) -> str:
    return f"CASE WHEN length(coalesce({x},'')) = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all({x}, '{pattern}'))::DOUBLE / length({x}) END"


def rare(x: str) -> str:
    words = found(fold(x), r"\b[A-Za-z][A-Za-z\-]{5,}\b")
    return f"least(len(list_distinct(list_filter({words}, lambda w: lower(w) NOT IN ({COMMON})))), 10)"


FORMULA = r"[=+\-/*^%<>\[\]{}]"
ESTIMATE = "greatest(1, floor(len({words}) * 1.3::DOUBLE)::INT)"


def words(x: str) -> str:
    return found(f"coalesce({x},'')", r"\S+")


SQL: dict[str, str] = {}
SQL["x01_normalize"] = f"WITH {T} SELECT entry_id, {norm('source_text')} AS source, {norm('target_text')} AS target FROM t"
TOKEN = rf"trim(regexp_replace(regexp_replace(lower({strip('line')}), '\d+', '#', 'g'), '\s+', ' ', 'g'))"
SQL["x02_line_tokens"] = f"WITH {O}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM o) SELECT {TOKEN} AS token, count(*) AS n FROM l GROUP BY 1"
SQL["x03_typeset"] = rf"""WITH {O} SELECT doc_id, block_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text,''), '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM o"""
SQL["x04_compact"] = r"SELECT doc_id, length(regexp_replace(coalesce(text,''), '\s+', '', 'g')) AS n_marks FROM documents"
SQL["x05_markers"] = rf"WITH {B} SELECT doc_id, block_id, CASE WHEN regexp_replace(coalesce(text,''), '\D', '', 'g') <> '' THEN regexp_replace(text, '\D', '', 'g') ELSE lower({strip('text')}) END AS marker FROM b WHERE block_type = 'footnote_marker'"
SLUG = "trim(regexp_replace(lower(coalesce({x},'')), '[^a-z0-9]+', '-', 'g'), '-')"
SQL["x06_slugs"] = f"WITH {T}, s AS (SELECT entry_id, {SLUG.format(x='source_text')} AS s FROM t WHERE unit = 'heading') SELECT entry_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM s"
SQL["x07_tokens"] = r"WITH l AS (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9\-]+')) AS token FROM documents) SELECT token, count(*) AS n FROM l GROUP BY 1"
SQL["x08_numbers"] = f"WITH {J} SELECT id, {joined(found(fold('text'), NUMBER))} AS numbers FROM j"
SQL["x09_links"] = f"WITH {J}, w AS (SELECT id, coalesce(text,'') || ' see https://example.org/' || id || ', www.example.org/b and end' AS t FROM j) SELECT id, {joined(found(fold('t'), LINK))} AS links FROM w"
SQL["x10_dates"] = f"WITH {J}, w AS (SELECT id, {fold('text')} || ' 2024-03-05, 5/3/2024 and March 5, 2024' AS t FROM j) SELECT id, {joined('list_concat(list_concat(' + found('t', DATES[0]) + ',' + found('t', DATES[1]) + '),' + found('t', DATES[2]) + ')')} AS dates FROM w"
SQL["x14_estimates"] = f"WITH {J} SELECT id, {ESTIMATE.format(words=words('text'))} AS by_words, greatest(1, floor(length(coalesce(text,'')) / 4)::INT) AS by_chars FROM j"
SQL["x13_hints"] = f"WITH {J}, f AS (SELECT id, {fold('text')} AS t FROM j), h AS (SELECT id, {hints('t')} AS h FROM f) SELECT id, array_to_string(({distinct_folded('h')})[1:12], ';') AS hints FROM h"
SQL["x15_ratios"] = f"SELECT doc_id, round({share('text', chr(92) + 'd')}, 9) AS digits, round({share('text', FORMULA)}, 9) AS formula FROM documents"
SQL["x16_lists"] = f"WITH {B} SELECT doc_id, block_id, round({lists('text')}, 9) AS density FROM b"
SQL["x17_rare_terms"] = f"WITH {J} SELECT id, {rare('text')} AS n_rare FROM j"
SQL["x19_heads"] = f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN coalesce(text,'') ELSE rtrim(left(text, 80), {WS}) END AS head, CASE WHEN length(text) <= 80 THEN coalesce(text,'') ELSE ltrim(right(text, 80), {WS}) END AS tail FROM documents"
SQL["x22_context_weight"] = f"WITH {J} SELECT id, length(coalesce(payload.context_before,'')) + length(coalesce(payload.context_after,'')) + length(coalesce(payload.chapter_notes,'')) + coalesce(list_sum(list_transform(payload.glossary, lambda g: length(coalesce(g.source,'')) + length(coalesce(g.target,'')))), 0)::INT AS weight FROM j"
SQL["x24_durations"] = """WITH s AS (SELECT event_id, greatest(0, floor(value * 100))::INT AS s FROM events) SELECT event_id,
  CASE WHEN s // 3600 > 0 THEN format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{:02d}:{:02d}', s % 3600 // 60, s % 60) END AS duration FROM s"""
SQL["x25_quality"] = f"WITH {T} SELECT CASE WHEN lower({strip('quality')}) IN ('draft','reviewed','approved','locked') THEN lower({strip('quality')}) ELSE 'draft' END AS quality, count(*) AS n FROM t GROUP BY 1"

ORD = "PARTITION BY doc_id ORDER BY page_num, reading_order, block_id"
SQL["w01_adjacency"] = f"WITH {B} SELECT doc_id, block_id, lag(block_id) OVER ({ORD}) AS prev_id, lead(block_id) OVER ({ORD}) AS next_id FROM b"
SIZE = "coalesce(style_metadata.max_font_size, 0.0)"
SECTIONS = f"""{B}, c AS (SELECT *, count(*) FILTER (WHERE block_type = 'heading') OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS no FROM b WHERE block_type NOT IN ('header','footer','image_anchor'))"""
SQL["w02_sections"] = f"""WITH {SECTIONS},
m AS (SELECT doc_id, median({SIZE}) AS m FROM b WHERE block_type = 'heading' AND {SIZE} > 0 GROUP BY 1),
h AS (SELECT doc_id, no, block_id AS hb, {strip('text')} AS t, {SIZE} AS size, coalesce(list_contains(flags, 'low_confidence_block_type'), false) AS unsure FROM c WHERE block_type = 'heading'),
s AS (SELECT doc_id, no, min(page_num) AS start_page, max(page_num) AS end_page, count(*) AS n_blocks FROM c WHERE no > 0 GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) FILTER (WHERE block_type NOT IN ('header','footer','image_anchor')) AS k, count(*) FILTER (WHERE block_type = 'heading') AS h,
  min(page_num) FILTER (WHERE block_type NOT IN ('header','footer','image_anchor')) AS a, max(page_num) FILTER (WHERE block_type NOT IN ('header','footer','image_anchor')) AS z, count(*) AS n FROM b GROUP BY 1)
SELECT s.doc_id, format('sec-{{:04d}}', no) AS section_id, CASE WHEN t <> '' THEN t ELSE 'Section ' || no END AS title, CASE WHEN starts_with(lower(t), 'chapter') THEN 1 WHEN size >= coalesce(m, 12.0) * 1.15::DOUBLE THEN 1 ELSE 2 END AS level,
  start_page, end_page, hb AS heading_block_id, n_blocks, CASE WHEN unsure THEN 0.62 ELSE 0.9 END::DOUBLE AS confidence FROM s JOIN h USING (doc_id, no) LEFT JOIN m USING (doc_id)
UNION ALL SELECT doc_id, 'sec-0001', 'Document', 1, CASE WHEN k = 0 THEN 1 ELSE a END, CASE WHEN k = 0 THEN 1 ELSE z END, NULL, CASE WHEN k = 0 THEN n ELSE k END, CASE WHEN k = 0 THEN 0.3 ELSE 0.45 END FROM d WHERE h = 0"""
CX = "coalesce((bbox.x0 + bbox.x1) / 2, 'inf'::DOUBLE)"
TOP, LEFT = "coalesce(bbox.y1, '-inf'::DOUBLE)", "coalesce(bbox.x0, 'inf'::DOUBLE)"
SQL["w03_reading_order"] = f"""WITH {E}, x AS (SELECT *, {CX} AS c, {TOP} AS y, block_type <> 'image_anchor' AND bbox IS NOT NULL AS txt FROM e),
g AS (SELECT doc_id, page_num, count(*) FILTER (WHERE txt) AS n, count(*) FILTER (WHERE txt AND c < 595.0 * 0.48) AS nl, count(*) FILTER (WHERE txt AND c > 595.0 * 0.52) AS nr,
  max(y) FILTER (WHERE txt AND c < 595.0 * 0.48) AS lmax, min(y) FILTER (WHERE txt AND c < 595.0 * 0.48) AS lmin, max(y) FILTER (WHERE txt AND c > 595.0 * 0.52) AS rmax, min(y) FILTER (WHERE txt AND c > 595.0 * 0.52) AS rmin FROM x GROUP BY 1, 2),
w AS (SELECT x.*, coalesce(n >= 8 AND nl >= 3 AND nr >= 3 AND least(lmax, rmax) > greatest(lmin, rmin), false) AS two_columns FROM x JOIN g USING (doc_id, page_num))
SELECT doc_id, block_id, two_columns, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY CASE WHEN two_columns AND c >= 595.0 * 0.5 THEN 1 ELSE 0 END, y DESC, {LEFT}, block_id) AS place FROM w"""
TITLED = r"NOT regexp_matches(t, '(?:^|[^\p{L}])\p{Ll}') AND NOT regexp_matches(t, '\p{L}\p{Lu}')"
SQL["cls01_line_kinds"] = f"""WITH {E}, x AS (SELECT *, {strip('text')} AS t, {SIZE} AS size FROM e WHERE block_type <> 'image_anchor'),
m AS (SELECT doc_id, page_num, median(size) AS m FROM x WHERE size > 0 GROUP BY 1, 2),
y AS (SELECT x.*, coalesce(m, 10.0) AS md, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY {TOP} DESC, {LEFT}, block_id) - 1 AS flow FROM x LEFT JOIN m USING (doc_id, page_num)),
z AS (SELECT *, CASE WHEN regexp_matches(t, '{NOTE_MARKER}') THEN 1 WHEN bbox IS NOT NULL AND bbox.y0 <= 842.0 * 0.22 AND regexp_matches(t, '{NOTE_BODY}') THEN 2 WHEN regexp_matches(t, '{CAPTION}') THEN 3
  WHEN md > 0 AND size >= md * 1.25::DOUBLE AND length(t) <= 120 THEN 4 WHEN flow <= 1 AND length(t) <= 80 AND {TITLED} THEN 5 WHEN length(t) < 5 THEN 6 ELSE 7 END AS r FROM y)
SELECT doc_id, block_id, ['footnote_marker','footnote_body','caption','heading','heading','paragraph','paragraph'][r] AS kind, ([0.55,0.8,0.85,0.88,0.6,0.55,0.78][r])::DOUBLE AS confidence FROM z"""
SQL["cls02_scanned_kinds"] = f"""WITH {O}, x AS (SELECT *, {strip('text')} AS t FROM o) SELECT doc_id, block_id, CASE WHEN t = '' THEN 'paragraph' WHEN regexp_matches(t, '{CAPTION}') THEN 'caption'
  WHEN bbox[2] <= 842.0 * 0.22 AND regexp_matches(t, '{NOTE_BODY}') THEN 'footnote_body' WHEN bbox[4] >= 842.0 * 0.84 AND length(t) <= 100 THEN 'heading' ELSE 'paragraph' END AS kind FROM x"""
CHUNK = "CASE WHEN block_type = 'paragraph' THEN 'paragraph_group' WHEN block_type IN ('heading','caption') THEN block_type WHEN block_type IN ('footnote_body','footnote_marker') THEN 'footnote' ELSE 'auxiliary' END"
SQL["cls03_chunk_types"] = f"WITH {B} SELECT {CHUNK} AS chunk_type, count(*) AS n FROM b GROUP BY 1"
SQL["cls07_font_sizes"] = f"""WITH {B}, s AS (SELECT doc_id, block_id, coalesce(CASE WHEN style_metadata.avg_font_size > 0 THEN style_metadata.avg_font_size END, CASE WHEN style_metadata.max_font_size > 0 THEN style_metadata.max_font_size END) AS s FROM b)
SELECT doc_id, block_id, CASE WHEN s IS NULL THEN 10.0::DOUBLE ELSE greatest(8.0, least(s, 18.0)) END AS size FROM s"""
SQL["cls08_clipped"] = f"""WITH {B}, x AS (SELECT doc_id, block_id, greatest(0.0, bbox.x0) + 1.5 AS a, greatest(0.0, bbox.y0) + 1.5 AS b, least(595.0, bbox.x1) - 1.5 AS c, least(842.0, bbox.y1) - 1.5 AS d FROM b WHERE bbox IS NOT NULL)
SELECT doc_id, block_id, CASE WHEN c > a AND d - b > 2 THEN a END AS x0, CASE WHEN c > a AND d - b > 2 THEN b END AS y0, CASE WHEN c > a AND d - b > 2 THEN c END AS x1, CASE WHEN c > a AND d - b > 2 THEN d END AS y1 FROM x"""
SQL["a01_page_sizes"] = f"""WITH {B}, p AS (SELECT doc_id, page_num, round(max(bbox.x1), 1) AS width, round(max(bbox.y1), 1) AS height FROM b WHERE bbox IS NOT NULL GROUP BY 1, 2)
SELECT width, height, count(*) AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, min((doc_id, page_num)) LIMIT 5"""
SQL["a02_inspection"] = rf"""WITH {B}, p AS (SELECT doc_id, page_num, bool_or({strip('text')} <> '') AS t, bool_or(block_type = 'image_anchor') AS i, bool_or(regexp_matches({strip('text')}, '{NOTE_BODY}') OR contains(lower({strip('text')}), 'footnotes') OR contains(lower({strip('text')}), 'endnotes')) AS f,
  sum(length(regexp_replace(coalesce(text,''), '\s+', '', 'g')))::BIGINT AS ch FROM b GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_pages, sum(ch)::BIGINT AS n_chars, bool_or(t) AS has_text, bool_or(i) AS has_images, bool_or(f) AS has_notes, (NOT bool_or(t) AND bool_or(i)) OR (avg(t::INT) < 0.2 AND avg(i::INT) >= 0.5) AS likely_scan FROM p GROUP BY 1"""
SQL["a04_furniture"] = f"""WITH {E}, x AS (SELECT *, {TOKEN.replace('line', 'text')} AS token FROM e WHERE bbox IS NOT NULL AND block_type <> 'image_anchor'),
h AS (SELECT doc_id, 'header' AS kind, block_id, token FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY bbox.y1 DESC, bbox.x0, block_id) = 1
  UNION ALL SELECT doc_id, 'footer', block_id, token FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY bbox.y0, block_id) = 1),
n AS (SELECT doc_id, count(DISTINCT page_num) AS np FROM e GROUP BY 1),
c AS (SELECT doc_id, kind, token FROM h JOIN n USING (doc_id) WHERE token <> '' GROUP BY doc_id, kind, token, np HAVING count(*) >= 2 AND count(*) / np >= 0.4)
SELECT doc_id, block_id, min(kind) AS kind FROM h JOIN c USING (doc_id, kind, token) GROUP BY 1, 2"""
SQL["a06_font_medians"] = f"WITH {B} SELECT doc_id, page_num, median(style_metadata.max_font_size) AS median_font FROM b WHERE style_metadata.max_font_size > 0 GROUP BY 1, 2"
SQL["a07_scan_quality"] = f"WITH {O} SELECT doc_id, page_num, count(*) AS n_blocks, round(avg(confidence), 6) AS confidence, count(*) FILTER (WHERE confidence < 0.65) AS n_low FROM o GROUP BY 1, 2"
SQL["a08_graph_counts"] = f"WITH {B} SELECT doc_id, count(DISTINCT page_num) AS n_pages, count(*) AS n_blocks, count(*) FILTER (WHERE block_type = 'heading') AS n_headings, count(*) FILTER (WHERE block_type = 'image_anchor') AS n_images, count(*) FILTER (WHERE starts_with(block_type, 'footnote')) AS n_notes FROM b GROUP BY 1"
CAPTIONS = f"""i AS (SELECT doc_id, page_num, block_id AS image_block_id, reading_order AS anchor FROM b WHERE block_type = 'image_anchor'),
k AS (SELECT doc_id, page_num, block_id AS c, reading_order AS ro, (block_type <> 'caption')::INT AS weak FROM b WHERE block_type = 'caption' OR (block_type = 'paragraph' AND regexp_matches({strip('text')}, '{CAPTION}'))),
m AS (SELECT i.doc_id, image_block_id, anchor, c, ro, weak FROM i LEFT JOIN k USING (doc_id, page_num) QUALIFY row_number() OVER (PARTITION BY i.doc_id, image_block_id ORDER BY weak, abs(ro - anchor), ro, c) = 1)"""
SQL["j10_captions"] = f"WITH {B}, {CAPTIONS} SELECT doc_id, image_block_id, c AS caption_block_id, CASE WHEN c IS NULL THEN 0.0 WHEN weak = 1 THEN 0.55 WHEN ro <= anchor THEN 0.92 ELSE 0.78 END::DOUBLE AS confidence FROM m"
ASSIGNED = f"""{SECTIONS}, own AS (SELECT doc_id, block_id, page_num, reading_order, no AS section_no FROM c WHERE no > 0),
rest AS (SELECT b.doc_id, b.block_id, b.page_num, b.reading_order FROM b ANTI JOIN own USING (doc_id, block_id)),
near AS (SELECT rest.doc_id, rest.block_id, own.section_no FROM rest JOIN own USING (doc_id, page_num) QUALIFY row_number() OVER (PARTITION BY rest.doc_id, rest.block_id ORDER BY abs(own.reading_order - rest.reading_order), own.reading_order, own.block_id) = 1),
prev AS (SELECT rest.doc_id, rest.block_id, max(own.section_no) AS section_no FROM rest JOIN own ON own.doc_id = rest.doc_id AND own.page_num < rest.page_num GROUP BY 1, 2),
frst AS (SELECT doc_id, min(section_no) AS section_no FROM own GROUP BY 1),
f AS (SELECT doc_id, block_id, section_no, false AS inferred FROM own UNION ALL SELECT rest.doc_id, rest.block_id, coalesce(near.section_no, prev.section_no, frst.section_no), true FROM rest LEFT JOIN near USING (doc_id, block_id) LEFT JOIN prev USING (doc_id, block_id) JOIN frst ON frst.doc_id = rest.doc_id)"""
SQL["j11_block_sections"] = f"WITH {ASSIGNED} SELECT * FROM f"
SQL["j12_image_anchors"] = f"""WITH {B}, {B.replace('b AS', 'xb AS', 1).replace('blocks', 'extracted_blocks', 1)}, i AS (SELECT DISTINCT doc_id, page_num, style_metadata.image_id AS image_id FROM xb WHERE style_metadata.image_id IS NOT NULL),
r AS (SELECT i.*, b.block_id AS anchor, row_number() OVER (PARTITION BY i.doc_id, i.page_num, i.image_id ORDER BY b.style_metadata.image_id IS DISTINCT FROM i.image_id, NOT contains(coalesce(b.text, ''), i.image_id), b.reading_order, b.block_id) AS n
 FROM i LEFT JOIN b ON b.doc_id = i.doc_id AND b.page_num = i.page_num AND b.block_type = 'image_anchor') SELECT doc_id, page_num, image_id, anchor FROM r WHERE n = 1"""
SQL["u01_edges"] = f"""WITH {ASSIGNED}, {CAPTIONS}, u AS (SELECT doc_id, 'page_block' AS kind, block_id AS target FROM b UNION ALL SELECT doc_id, 'next_block', n FROM (SELECT doc_id, lead(block_id) OVER ({ORD}) AS n FROM b) WHERE n IS NOT NULL
  UNION ALL SELECT doc_id, 'section_block', block_id FROM f UNION ALL SELECT doc_id, 'image_caption', c FROM m WHERE c IS NOT NULL) SELECT doc_id, kind, count(*) AS n, min(target) AS first FROM u GROUP BY 1, 2"""
SQL["v01_graph_errors"] = f"""WITH {B} SELECT doc_id, block_id, 'dangling_prev' AS error FROM b WHERE prev_block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b x WHERE x.doc_id = b.doc_id AND x.block_id = b.prev_block_id)
UNION ALL SELECT doc_id, block_id, 'dangling_next' FROM b WHERE next_block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b x WHERE x.doc_id = b.doc_id AND x.block_id = b.next_block_id)
UNION ALL SELECT b.doc_id, b.block_id, 'asymmetric_next' FROM b JOIN b x ON x.doc_id = b.doc_id AND x.block_id = b.next_block_id WHERE x.prev_block_id IS DISTINCT FROM b.block_id
UNION ALL SELECT doc_id, block_id, 'missing_section' FROM b WHERE section_id IS NULL"""
SQL["r06_footnotes"] = rf"""WITH {B}, i AS (SELECT doc_id, page_num, block_id, block_type, regexp_extract_all(coalesce(text,''), '\[(\d{{1,3}})\]', 1) AS m FROM b WHERE block_type <> 'footnote_body')
SELECT doc_id, page_num, block_id, 'body' AS kind, nullif(regexp_extract(coalesce(text,''), '^\s*(\[?\d{{1,3}}\]?|\d{{1,3}}[.)])\s+\S+', 1), '') AS marker, 0 AS pos FROM b WHERE block_type = 'footnote_body'
UNION ALL SELECT doc_id, page_num, block_id, 'marker', m[k], k - 1 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM i)
UNION ALL SELECT doc_id, page_num, block_id, 'marker', {strip('text')}, 1000000 FROM b WHERE block_type = 'footnote_marker' AND {strip('text')} <> ''"""
SQL["r08_page_flags"] = f"WITH {B}, p AS (SELECT doc_id, page_num, bool_or(block_type <> 'image_anchor' AND {strip('text')} <> '') AS t, bool_or(block_type = 'image_anchor') AS i FROM b GROUP BY 1, 2) SELECT doc_id, page_num, concat_ws(',', CASE WHEN NOT t THEN 'no_text_detected' END, CASE WHEN i THEN 'contains_images' END) AS flags FROM p"
SQL["r24_page_members"] = f"""WITH {B}, s AS (SELECT doc_id, page_num, section_id, min((reading_order, block_id)) AS k FROM b WHERE section_id IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT doc_id, page_num, string_agg(section_id, ',' ORDER BY k) AS s FROM s GROUP BY 1, 2)
SELECT b.doc_id, b.page_num, string_agg(block_id, ',' ORDER BY reading_order, block_id) AS block_ids, coalesce(any_value(g.s), '') AS section_ids, coalesce(string_agg(block_id, ',' ORDER BY reading_order, block_id) FILTER (WHERE block_type = 'image_anchor'), '') AS image_ids
FROM b LEFT JOIN g USING (doc_id, page_num) GROUP BY 1, 2"""
SQL["s05_text_lines"] = rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text,''), '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text,''), '\r\n|\n|\r'), 1) AS i FROM documents),
k AS (SELECT doc_id, i, trim(line, {WS}) AS t FROM l WHERE trim(line, {WS}) <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM k)
SELECT doc_id AS doc, place, t AS text, 842.0::DOUBLE - (place - 1) * 14.0::DOUBLE - 14.0::DOUBLE AS y0, 842.0::DOUBLE - (place - 1) * 14.0::DOUBLE AS y1 FROM p"""
SQL["f07_multi_column"] = rf"""WITH w AS (SELECT doc_id, len(list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '\S.{{0,50}}\s{{7,}}\S'))) AS w,
 len(list_filter(string_split(regexp_replace(coalesce(text,''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS n FROM documents) SELECT doc_id, w >= 3 OR (w >= 2 AND w >= 0.25 * n) AS multi_column FROM w"""

PACK = f"""{B}, q AS (SELECT doc_id, block_id, page_num, reading_order, block_type, coalesce(section_id, 'section-unknown') AS ch, length(coalesce(text,'')) AS n, {strip('text')} AS t, row_number() OVER ({ORD}) AS rn FROM b),
r(doc_id, rn, no, k, c, para, ch) AS (SELECT doc_id, rn, 1, 1, n, block_type = 'paragraph', ch FROM q WHERE rn = 1
  UNION ALL SELECT q.doc_id, q.rn,
    CASE WHEN r.para AND q.block_type = 'paragraph' AND q.ch = r.ch AND r.k < 8 AND r.c + 1 + q.n <= 1200 THEN r.no ELSE r.no + 1 END,
    CASE WHEN r.para AND q.block_type = 'paragraph' AND q.ch = r.ch AND r.k < 8 AND r.c + 1 + q.n <= 1200 THEN r.k + 1 ELSE 1 END,
    CASE WHEN r.para AND q.block_type = 'paragraph' AND q.ch = r.ch AND r.k < 8 AND r.c + 1 + q.n <= 1200 THEN r.c + 1 + q.n ELSE q.n END,
    q.block_type = 'paragraph', q.ch FROM r JOIN q ON q.doc_id = r.doc_id AND q.rn = r.rn + 1)"""
SQL["w05_packing"] = f"WITH RECURSIVE {PACK} SELECT q.doc_id, q.block_id, r.no AS chunk_no FROM q JOIN r USING (doc_id, rn)"
CHUNKS = f"""{PACK}, k AS (SELECT q.doc_id, r.no, any_value(q.ch) AS chapter_id, any_value({CHUNK}) AS chunk_type, min(page_num) AS start_page, max(page_num) AS end_page, list(block_id ORDER BY rn) AS ids, min(rn) AS first, max(rn) AS last,
  coalesce(string_agg(t, chr(10) ORDER BY rn) FILTER (WHERE t <> ''), '') AS source_text FROM q JOIN r USING (doc_id, rn) GROUP BY 1, 2)"""
SQL["c02_chunks"] = f"WITH RECURSIVE {CHUNKS} SELECT doc_id, format('chk-{{:05d}}', no) AS chunk_id, chapter_id, chunk_type, start_page, end_page, array_to_string(ids, ',') AS block_ids, source_text, {ESTIMATE.format(words=words('source_text'))} AS token_estimate FROM k"
SQL["w06_contexts"] = f"""WITH RECURSIVE {CHUNKS}, x AS (SELECT k.doc_id, k.no,
  coalesce(string_agg(q.t, chr(10) ORDER BY q.rn) FILTER (WHERE q.rn < k.first AND q.t <> ''), '') AS b, coalesce(string_agg(q.t, chr(10) ORDER BY q.rn) FILTER (WHERE q.rn > k.last AND q.t <> ''), '') AS a
  FROM k LEFT JOIN q ON q.doc_id = k.doc_id AND (q.rn BETWEEN k.first - 2 AND k.first - 1 OR q.rn BETWEEN k.last + 1 AND k.last + 2) GROUP BY 1, 2)
SELECT doc_id, no AS chunk_no, CASE WHEN length(b) <= 280 THEN b ELSE ltrim(right(b, 280), {WS}) END AS before, CASE WHEN length(a) <= 280 THEN a ELSE rtrim(left(a, 280), {WS}) END AS after FROM x"""


def assess(rel: str, x: str, odd: str, rare_sql: str) -> str:
    inline = rf"len(list_distinct(regexp_extract_all(coalesce({x},''), '\[(?:\d+|\w+)\]')))"
    return f"""fe AS (SELECT *, length(coalesce({x},'')) AS n_chars, {inline} AS notes, {rare_sql} AS rare, {share(x, chr(92) + 'd')} AS dg, {share(x, FORMULA)} AS fm, {lists(x)} AS li, contains(coalesce({x},''), '|') AND contains(coalesce({x},''), chr(10)) AS tb, {odd} AS odd FROM {rel}),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(n_chars / 1800.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(notes / 4.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE + least(rare / 8.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + least((dg + fm) * 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE
  + least(li * 2.0::DOUBLE + CASE WHEN tb THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) * 0.15::DOUBLE + CASE WHEN odd THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS score,
  concat_ws(',', CASE WHEN notes > 0 THEN 'footnote_markers' END, CASE WHEN rare >= 3 THEN 'terminology_dense' END, CASE WHEN dg + fm >= 0.12::DOUBLE THEN 'numeric_or_formula_dense' END, CASE WHEN li >= 0.25::DOUBLE OR tb THEN 'list_or_table_structure' END, CASE WHEN odd THEN 'layout_sensitive' END) AS risks FROM fe)"""


SQL["cls04_complexity"] = f"WITH {J}, {assess('j', 'text', 'false', rare('text'))} SELECT id, n_chars, notes, rare, round(score, 9) AS score, risks, CASE WHEN score >= 0.68::DOUBLE THEN 'C' WHEN score >= 0.34::DOUBLE THEN 'B' ELSE 'A' END AS tier FROM sc"
SQL["cls05_tiers"] = f"WITH {J}, {assess('j', 'text', 'false', rare('text'))} SELECT profile_name, CASE WHEN score >= tier_c_threshold THEN 'C' WHEN score >= tier_b_threshold THEN 'B' ELSE 'A' END AS tier, count(*) AS n FROM sc JOIN economy_profiles ON name = profile_name GROUP BY 1, 2"
HINTED = f"h AS (SELECT *, ({distinct_folded('hh')})[1:12] AS hints FROM (SELECT *, {hints('ft')} AS hh FROM (SELECT *, {fold('source_text')} AS ft FROM k)))"
RARE_H = f"CASE WHEN len(hints) > 0 THEN len(list_distinct(list_transform(hints, lambda v: lower(v)))) ELSE {rare('source_text')} END"
SQL["c02_routing"] = f"""WITH RECURSIVE {CHUNKS}, {HINTED}, {assess('h', 'source_text', "chunk_type <> 'paragraph_group'", RARE_H)}
SELECT chunk_type, CASE WHEN score >= 0.68::DOUBLE THEN 'C' WHEN score >= 0.34::DOUBLE THEN 'B' ELSE 'A' END AS tier, count(*) AS n_chunks, sum({ESTIMATE.format(words=words('source_text'))})::BIGINT AS tokens, round(avg(score), 6) AS score FROM sc GROUP BY 1, 2"""
SQL["w07_split"] = f"""WITH RECURSIVE {CHUNKS}, {HINTED}, {assess('h', 'source_text', "chunk_type <> 'paragraph_group'", RARE_H)},
x AS (SELECT doc_id, format('chk-{{:05d}}', no) AS parent, ids, unnest(range(0, (len(ids) - 1) // 2 + 1)) AS i FROM sc WHERE chunk_type = 'paragraph_group' AND score >= 0.3::DOUBLE AND len(ids) > 1)
SELECT doc_id, parent || '-s' || (i + 1) AS chunk_id, parent, array_to_string(ids[i * 2 + 1 : i * 2 + 2], ',') AS block_ids FROM x"""
SQL["w08_merge"] = f"""WITH RECURSIVE {CHUNKS}, {assess('k', 'source_text', "chunk_type <> 'paragraph_group'", rare('source_text'))},
y AS (SELECT doc_id, no, chunk_type = 'paragraph_group' AND lead(chunk_type) OVER w = 'paragraph_group' AND chapter_id = lead(chapter_id) OVER w AND score < 0.25 AND lead(score) OVER w < 0.25 AND n_chars + lead(n_chars) OVER w <= 2100 AND len(ids) + lead(len(ids)) OVER w <= 12 AS fits FROM sc WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
m(doc_id, no, took) AS (SELECT doc_id, no, coalesce(fits, false) FROM y WHERE no = 1 UNION ALL SELECT y.doc_id, y.no, coalesce(y.fits, false) AND NOT m.took FROM m JOIN y ON y.doc_id = m.doc_id AND y.no = m.no + 1)
SELECT doc_id, format('chk-{{:05d}}', no) AS chunk_id, format('chk-{{:05d}}', no + 1) AS with_id FROM m WHERE took"""
SQL["v02_chunk_errors"] = f"WITH RECURSIVE {CHUNKS} SELECT doc_id, format('chk-{{:05d}}', no) AS chunk_id, 'empty_text' AS error FROM k WHERE source_text = ''"

GLOSSARY = f"""g0 AS (SELECT {strip('source_term')} AS s, {strip('target_term')} AS target_term, lower({strip('decision')}) AS decision FROM glossary),
g AS (SELECT {norm('s')} AS key, s, target_term, decision FROM g0 WHERE s <> '' AND target_term <> '' QUALIFY row_number() OVER (PARTITION BY {norm('s')} ORDER BY CASE decision WHEN 'locked' THEN 0 WHEN 'approved' THEN 1 WHEN 'rejected' THEN 3 ELSE 2 END, target_term, s) = 1)"""
SQL["r01_clean_terms"] = f"WITH {GLOSSARY} SELECT key, target_term, decision FROM g"
SQL["j04_exact_terms"] = f"WITH {J}, {GLOSSARY}, n AS (SELECT id, {norm('text')} AS t FROM j) SELECT id, key AS term FROM n JOIN g ON contains(t, key)"
EXACT = f"""x AS (SELECT id, entry_id, target_text AS target FROM (SELECT id, chapter_id AS c, {norm('text')} AS key FROM j) q JOIN (SELECT *, {norm('source_text')} AS key FROM t WHERE {strip('target_text')} <> '') m USING (key) WHERE key <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN c IS NOT DISTINCT FROM chapter_id THEN 0 ELSE 1 END, entry_id) = 1)"""
SQL["j07_exact_matches"] = f"WITH {J}, {T}, {EXACT} SELECT * FROM x"
SQL["j08_contained_terms"] = f"""WITH {J}, {T}, n AS (SELECT id, chapter_id, {norm('text')} AS t FROM j), e AS (SELECT entry_id, chapter_id, {norm('source_text')} AS s FROM t WHERE lower({strip('quality')}) IN ('approved','locked')),
r AS (SELECT id, entry_id, row_number() OVER (PARTITION BY id ORDER BY entry_id) AS place FROM n JOIN e ON (coalesce(n.chapter_id, '') = '' OR n.chapter_id = e.chapter_id) AND s <> '' AND contains(t, s)) SELECT * FROM r WHERE place <= 5"""
SQL["f05_glossary_lookup"] = "SELECT * FROM glossary WHERE contains(lower(coalesce(source_term,'') || ' ' || coalesce(target_term,'') || ' ' || coalesce(part_of_speech,'') || ' ' || coalesce(decision,'') || ' ' || coalesce(notes,'')), 're') ORDER BY source_term NULLS FIRST, target_term NULLS FIRST, part_of_speech NULLS FIRST, decision NULLS FIRST, notes NULLS FIRST LIMIT 10"
TK = r"regexp_extract_all(lower({x}), '[A-Za-zА-Яа-яЁё0-9\-]+')"
SQL["t04_style_rules"] = f"""WITH {J}, u(ord, rule) AS (VALUES (1, 'Keep numbers and the kg unit as in the source'), (2, 'Use the formal system of terms'), (3, 'Names of towns are transliterated'), (4, 'Никогда не меняйте порядок предложений')),
v AS (SELECT ord, rule, list_distinct({TK.format(x='rule')}) AS w FROM u), n AS (SELECT id, list_distinct({TK.format(x="coalesce(text,'')")}) AS t FROM j),
s AS (SELECT id, rule, len(list_intersect(w, t))::DOUBLE / greatest(1, len(w)) AS coverage, ord FROM n, v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coverage DESC, ord) AS place FROM s)
SELECT id, rule, round(coverage, 9) AS coverage, place FROM r WHERE place <= 3 AND (coverage > 0 OR place = 1)"""

NO_SPACE = r"regexp_replace({x}, '\s+', '', 'g')"


def date_ok(v: str, t: str) -> str:
    return rf"(contains({t}, {v}) OR len(list_filter(regexp_extract_all({v}, '\d+'), lambda z: NOT contains({t}, z))) = 0)"


def equation_ok(v: str, t: str) -> str:
    digits = rf"regexp_extract_all({v}, '\d+(?:[.,]\d+)?')"
    side = f"trim(split_part({v}, '=', 1))"
    return f"(contains({t}, {v}) OR contains({NO_SPACE.format(x=t)}, {v}) OR (contains({v}, '=') AND contains({t}, '=') AND (({side} <> '' AND contains({t}, {side})) OR (len({digits}) > 0 AND len(list_filter({digits}, lambda z: NOT contains({t}, z))) = 0))))"


SQL["x12_supported"] = f"WITH {J}, w AS (SELECT id, coalesce(text,'') || ' 5.3.2024 x = 4' AS t FROM j) SELECT id, {date_ok(chr(39) + '2024-3-5' + chr(39), 't')} AS date, {date_ok(chr(39) + '1999-12-31' + chr(39), 't')} AS no_date, {equation_ok(chr(39) + 'x=4' + chr(39), 't')} AS equation, {equation_ok(chr(39) + 'zq=977' + chr(39), 't')} AS no_equation FROM w"
SQL["x11_equations"] = f"WITH {J}, w AS (SELECT id, {fold('text')} || chr(10) || 'x1 = 2 + ' || length(coalesce(text,'')) || '; done' AS t FROM j) SELECT id, {joined('list_filter(list_transform(' + found('t', EQUATION) + ', lambda x: ' + NO_SPACE.format(x='x') + '), lambda x: x <> ' + chr(39) * 2 + ')', '|')} AS equations FROM w"
FLAGS = rf"""{P}, f0 AS (SELECT id, target_text IS NOT NULL AS given, coalesce(target_text,'') AS t, {strip('target_text')} AS st, coalesce(source_text,'') AS s, {fold('source_text')} AS fs FROM p),
f1 AS (SELECT *, given AND st <> '' AS said, list_sort(list_distinct(regexp_extract_all(s, '\[(\d{{1,3}})\]', 1))) AS marks, list_sort(list_distinct({found('fs', NUMBER)})) AS nums, list_sort(list_distinct({found('fs', LINK)})) AS links,
  list_sort(list_distinct(list_concat(list_concat({found('fs', DATES[0])}, {found('fs', DATES[1])}), {found('fs', DATES[2])}))) AS dates FROM f0),
f2 AS (SELECT id, unnest([CASE WHEN NOT given THEN 'missing_translation' END, CASE WHEN given AND NOT said THEN 'empty_translation' END,
  CASE WHEN said AND len(list_filter(marks, lambda m: NOT contains(t, m))) > 0 THEN 'footnote_marker_missing' END,
  CASE WHEN said AND len(marks) > 0 AND coalesce(list_sum(list_transform(marks, lambda m: (length(t) - length(replace(t, m, ''))) // length(m))), 0) <> len(marks) THEN 'footnote_count_mismatch' END,
  CASE WHEN said AND len(list_filter(nums, lambda m: NOT contains(t, m))) > 0 THEN 'number_missing' END, CASE WHEN said AND len(list_filter(links, lambda m: NOT contains(t, m))) > 0 THEN 'link_missing' END,
  CASE WHEN said AND len(list_filter(dates, lambda m: NOT {date_ok('m', 't')})) > 0 THEN 'date_missing' END,
  CASE WHEN said AND len(list_filter(list_transform({found('fs', EQUATION)}, lambda x: {NO_SPACE.format(x='x')}), lambda m: NOT {equation_ok('m', 't')})) > 0 THEN 'formula_content_missing' END]) AS rule_id FROM f1),
f AS (SELECT * FROM f2 WHERE rule_id IS NOT NULL)"""
SEV = "CASE WHEN rule_id IN ('missing_translation','empty_translation','footnote_marker_missing','link_missing') THEN 'high' ELSE 'medium' END"
LOST = {"footnote_marker_missing": ("list_filter(m0, lambda m: NOT contains(t, m))", 50), "number_missing": ("list_filter(nums, lambda m: NOT contains(t, m))", 12), "link_missing": ("list_filter(links, lambda m: NOT contains(t, m))", 8),
  "date_missing": (f"list_filter(dates, lambda m: NOT {date_ok('m', 't')})", 8), "formula_content_missing": (f"list_filter(eqs, lambda m: NOT {equation_ok('m', 't')})", 8)}
DETAILS = " ".join(f"WHEN '{k}' THEN array_to_string(({v})[1:{n}], ';')" for k, (v, n) in LOST.items())
SQL["c12_pair_flags"] = rf"""WITH {FLAGS}, d AS (SELECT f1.*, {distinct_folded("regexp_extract_all(s, '" + chr(92) + "[(" + chr(92) + "d{1,3})" + chr(92) + "]', 1)")} AS m0,
  list_sort(list_distinct(list_filter(list_transform({found('fs', EQUATION)}, lambda x: {NO_SPACE.format(x='x')}), lambda x: x <> ''))) AS eqs FROM f1)
SELECT id, rule_id, {SEV} AS severity, CASE rule_id WHEN 'footnote_count_mismatch' THEN len(marks) || '/' || coalesce(list_sum(list_transform(marks, lambda m: (length(t) - length(replace(t, m, ''))) // length(m))), 0)::INT {DETAILS} ELSE '' END AS details FROM f JOIN d USING (id)"""
SQL["a09_flag_counts"] = f"WITH {FLAGS} SELECT rule_id, count(*) AS n FROM f GROUP BY 1"
SQL["k04_flag_report"] = f"WITH {FLAGS}, c AS (SELECT rule_id, count(*) AS n FROM f GROUP BY 1) SELECT '# Flags' || chr(10) || chr(10) || 'Total: ' || coalesce(sum(n), 0) || chr(10) || chr(10) || string_agg('- ' || rule_id || ': ' || n, chr(10) ORDER BY n DESC, rule_id) AS report FROM c"
SQL["a13_stable_expressions"] = f"WITH {T}, n AS (SELECT {norm('source_text')} AS source, {norm('target_text')} AS target FROM t) SELECT source, count(DISTINCT target) AS n_targets, count(*) AS n_pairs FROM n WHERE source <> '' AND target <> '' GROUP BY 1 HAVING count(DISTINCT target) > 1"
TERMS = f"g1 AS (SELECT DISTINCT {strip('source_term')} AS source_term, {strip('target_term')} AS target_term FROM glossary WHERE {strip('source_term')} <> '' AND {strip('target_term')} <> '')"
CONFLICT = f"n AS (SELECT id, {norm('source_text')} AS s, {norm('target_text')} AS t FROM p), {TERMS}, x AS (SELECT id, source_term, target_term FROM n JOIN g1 ON contains(s, {norm('source_term')}) WHERE NOT contains(t, {norm('target_term')}))"
SQL["r26_term_conflicts"] = f"WITH {P}, {CONFLICT} SELECT * FROM x"
RATIO = f"greatest(1, len({words('target_text')}))::DOUBLE / greatest(1, len({words('source_text')}))"
SQL["r27_literalness"] = f"WITH {P}, r AS (SELECT id, {RATIO} AS ratio FROM p) SELECT * FROM r WHERE ratio < 0.45 OR ratio > 2.2"
NAMES = f"m AS (SELECT id, {norm('target_text')} AS t, unnest({found(fold('source_text'), NAME)}) AS name FROM p), w AS (SELECT id, name FROM m WHERE name NOT IN ('The','A','An','In','On','At','By','Of') AND NOT contains(t, lower(name)))"
SQL["r28_names_missing"] = f"WITH {P}, {NAMES} SELECT id, name, count(*) AS n FROM w GROUP BY 1, 2"
SQL["c11_consistency"] = f"""WITH {P}, {CONFLICT}, {NAMES}, st AS (SELECT s FROM n WHERE s <> '' AND t <> '' GROUP BY 1 HAVING count(DISTINCT t) > 1), r AS (SELECT id, {RATIO} AS ratio FROM p),
u AS (SELECT id, 'terminology_conflict' AS type, 'high' AS severity FROM x UNION ALL SELECT id, 'stable_expression_inconsistency', 'medium' FROM n JOIN st USING (s) UNION ALL SELECT id, 'literalness_drift', 'medium' FROM r WHERE ratio < 0.45 OR ratio > 2.2 UNION ALL SELECT id, 'name_consistency_warning', 'low' FROM w)
SELECT id, type, severity, count(*) AS n FROM u GROUP BY 1, 2, 3"""
SQL["f04_risk_candidates"] = rf"""WITH {FLAGS}, {GLOSSARY}, h AS (SELECT id FROM (SELECT id, {norm('s')} AS t FROM f1) z JOIN g ON contains(t, key) GROUP BY 1 HAVING count(DISTINCT key) >= 4), c AS (SELECT id, len(marks) >= 2 OR len({found('fs', EQUATION)}) > 0 OR length(s) >= 1200 OR id IN (SELECT id FROM h) AS dense FROM f1 WHERE st <> '')
SELECT id FROM c WHERE dense OR id IN (SELECT id FROM f)"""

CAPS = r"regexp_matches({s}, '^\d+(?:[./-]\d+)*$') OR regexp_matches({s}, '^[^\p{{L}}\p{{N}}]+$')"
PLAN = f"""q AS (SELECT id, {strip('text')} AS s, {norm('text')} AS key, text FROM j), {EXACT},
c AS (SELECT q.*, CASE WHEN s = '' THEN 'empty_source' WHEN {CAPS.format(s='s')} THEN 'non_translatable_fragment' END AS cheap FROM q),
y AS (SELECT c.*, x.target FROM c LEFT JOIN x USING (id)), z AS (SELECT *, first_value(CASE WHEN cheap IS NULL THEN target END IGNORE NULLS) OVER (PARTITION BY key, cheap IS NULL ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rep FROM y),
pl AS (SELECT id, CASE WHEN cheap IS NOT NULL THEN 'skip' WHEN rep IS NOT NULL OR target IS NOT NULL THEN 'reuse' ELSE 'model' END AS action,
 CASE WHEN cheap IS NOT NULL THEN cheap WHEN rep IS NOT NULL THEN 'repeated_approved_translation' WHEN target IS NOT NULL THEN 'translation_memory_exact' ELSE 'requires_model_translation' END AS reason,
 CASE WHEN cheap = 'empty_source' THEN NULL WHEN cheap IS NOT NULL THEN s ELSE coalesce(rep, target) END AS target FROM z)"""
SQL["c04_exact"] = f"WITH {J}, {T}, {PLAN} SELECT * FROM pl"
SQL["a10_exact_summary"] = f"WITH {J}, {T}, {PLAN} SELECT action, reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM pl), 9) AS share FROM pl GROUP BY 1, 2"
LET, UPP = r"len(regexp_extract_all(s, '\p{L}'))", r"len(regexp_extract_all(s, '\p{Lu}'))"
SQL["f01_fragments"] = f"""WITH {B}, x AS (SELECT doc_id, block_id, {strip('text')} AS s, block_type IN ('header','footer') AS aux FROM b)
SELECT doc_id, block_id FROM x WHERE s <> '' AND ({CAPS.format(s='s')} OR (aux AND length(s) <= 80 AND ({LET} = 0 OR {UPP}::DOUBLE / {LET} >= 0.65)))"""
SQL["x21_fingerprints"] = f"WITH {J}, n AS (SELECT id, template_id, {norm('text')} AS t, src, tgt FROM j) SELECT id, min(id) OVER w AS first, count(*) OVER w AS n FROM n WINDOW w AS (PARTITION BY template_id, t, src, tgt)"
SQL["f11_checks"] = f"""WITH q AS ({SQL['cls04_complexity']}) SELECT id, tier = 'C' OR contains(risks, 'terminology_dense') AS run_editorial,
tier = 'C' OR contains(risks, 'footnote_markers') OR contains(risks, 'terminology_dense') OR contains(risks, 'numeric_or_formula_dense') AS run_qa FROM q"""
SQL["r03_local_targets"] = f"""WITH {J}, {T}, {A}, {PLAN} SELECT pl.id, coalesce(nullif(pl.target, ''), nullif(a.translated_text, ''), CASE WHEN action = 'skip' THEN coalesce(j.text, '') END, '') AS target
FROM pl JOIN j USING (id) LEFT JOIN (SELECT * FROM a WHERE status = 'ok') a USING (id)"""
SQL["j14_cached"] = f"""WITH {J}, {A}, k AS (SELECT id, template_id, {norm('text')} AS t, src, tgt FROM j), c AS (SELECT DISTINCT k.template_id, t, src, tgt FROM k JOIN a USING (id) WHERE a.status = 'ok' AND a.translated_text IS NOT NULL)
SELECT false AS blank, count(DISTINCT id) AS n FROM k JOIN c USING (template_id, t, src, tgt)"""
CH = f"CASE WHEN {strip('chapter_id')} = '' THEN 'range' ELSE {strip('chapter_id')} END"
BATCH = f"""c AS (SELECT book_id, id, {CH} AS ch FROM j), n AS (SELECT *, (ch IS DISTINCT FROM lag(ch) OVER w)::INT AS new FROM c WINDOW w AS (PARTITION BY book_id ORDER BY id)), r AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY id) AS run FROM n),
o AS (SELECT *, ((row_number() OVER (PARTITION BY book_id, run ORDER BY id) - 1) % 24 = 0)::INT AS opens FROM r), z AS (SELECT *, sum(opens) OVER (PARTITION BY book_id ORDER BY id)::INT AS no FROM o),
bt AS (SELECT book_id, id, format('batch-{{:04d}}-', no) || CASE WHEN {SLUG.format(x='ch')} = '' THEN 'batch' ELSE {SLUG.format(x='ch')} END AS batch_id FROM z)"""
SQL["j17_tasks"] = f"WITH {J}, {T}, pp AS (SELECT * FROM (WITH {PLAN} SELECT * FROM pl)), {BATCH} SELECT book_id, batch_id, id, CASE WHEN action IS NULL THEN 'failed' ELSE 'pending' END AS status, CASE WHEN action IS NULL THEN 'no plan for ' || id END AS error, action FROM bt LEFT JOIN pp USING (id)"
SQL["f03_selection"] = f"""WITH {J}, {A}, {BATCH}, st AS (SELECT book_id, batch_id, CASE WHEN bool_and(a.id IS NOT NULL AND {strip('translated_text')} <> '') THEN 'completed' WHEN bool_or(coalesce(status = 'failed', false)) THEN 'failed' ELSE 'pending' END AS status
 FROM bt LEFT JOIN a USING (id) GROUP BY 1, 2) SELECT * FROM st WHERE status IN ('pending', 'failed')"""
SQL["w10_batches"] = f"WITH {J}, {BATCH} SELECT * FROM bt"
SQL["a15_batch_progress"] = f"WITH {J}, {A}, {BATCH}, d AS (SELECT DISTINCT id FROM a WHERE {strip('translated_text')} <> '') SELECT book_id, batch_id, count(*) AS n_chunks, count(d.id) AS n_done, bool_and(d.id IS NOT NULL) AS completed FROM bt LEFT JOIN d USING (id) GROUP BY 1, 2"
SQL["u06_remaining"] = f"WITH {J}, {A} SELECT id FROM j WHERE id NOT IN (SELECT id FROM a WHERE status = 'ok')"
SQL["j02_merged_answers"] = f"""WITH {A}, u AS (SELECT id, translated_text AS text, 0 AS p FROM a UNION ALL SELECT id, 'edited ' || coalesce(translated_text,''), 1 FROM a WHERE source = 'lite_backend'), v AS (SELECT * FROM u WHERE {strip('text')} <> '') SELECT id, arg_max(text, p) AS text FROM v GROUP BY 1"""
SQL["h04_mock"] = f"WITH {J} SELECT id, CASE WHEN id = 'job-000000001' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN id <> 'job-000000001' THEN '[MOCK_RU] ' || coalesce(text,'') END AS target FROM j"
SQL["r15_job_inputs"] = f"WITH {J} SELECT id AS job_id, src, length(text) AS n_chars FROM j"
SQL["x27_prompts"] = f"WITH {J} SELECT id AS job_id, 'From ' || src || ' to ' || tgt || ' (' || coalesce(chunk_id,'') || '):' || chr(10) || coalesce(text,'') AS prompt FROM j"
SQL["a14_run_summary"] = f"WITH {A} SELECT source, count(*) AS n_jobs, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE {strip('translated_text')} = '') AS n_empty, sum(len(coalesce(errors, [])))::BIGINT AS n_errors FROM a GROUP BY 1"
SQL["w14_widows"] = "WITH n AS (SELECT doc_id, floor(length(coalesce(text,'')) / 60)::INT AS n FROM documents), c AS (SELECT doc_id, n, CASE WHEN n - 7 < 2 THEN n - 2 ELSE 7 END AS c FROM n) SELECT doc_id, CASE WHEN n <= 7 THEN n WHEN c < 2 THEN CASE WHEN n < 4 THEN 0 ELSE 2 END ELSE c END AS lines_kept FROM c"
SQL["ext_event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
SQL["cls10_payload_flags"] = f"""WITH {A}, i AS (SELECT id, unnest(errors) AS e FROM a) SELECT id, 'semantic_issue' AS rule_id, 'high' AS severity, coalesce(e, '') AS message FROM i
UNION ALL SELECT id, 'semantic_failed', 'medium', '' FROM a WHERE status IS DISTINCT FROM 'ok' AND len(coalesce(errors, [])) = 0"""
TYPESET = SQL["x03_typeset"].split(" block_id, ")[1].split(" AS text")[0]
SQL["j18_page_notes"] = rf"""WITH {B}, {E}, s AS (SELECT doc_id, page_num, block_id, {TYPESET} AS text FROM e WHERE block_type = 'footnote_body'), t AS (SELECT * FROM s WHERE text <> ''),
r AS (SELECT doc_id, page_num, block_id, {TYPESET} AS tt, trim(regexp_extract(coalesce(text,''), '^\s*(\[?\d{{1,3}}\]?|\d{{1,3}}[.)])\s', 1)) AS m FROM b WHERE block_type = 'footnote_body')
SELECT * FROM t UNION ALL SELECT doc_id, page_num, block_id, concat_ws(' ', nullif(m, ''), tt) FROM r WHERE tt <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND t.block_id = r.block_id)"""
