"""SQL of the queries, for an independent engine. NFKC changes no text of the test tables, so it is left out here but for str_nfkc."""

from __future__ import annotations

# Fixed values, stated again so that they don't follow the code under test: what a token is, and the texts of issues.
TOK = r"[\p{L}\p{N}_]+(?:[./%-][\p{L}\p{N}_]+)*"
MESSAGES = {
    "OCR_CROSS_VALIDATION_UNAVAILABLE": "The page appears to be scanned or image-based. pdfplumber does not provide a usable native text layer, so Docling OCR output cannot be cross-validated with pdfplumber.",
    "DOCLING_OCR_OUTPUT_EMPTY": "Docling produced no text for an image-based page. Manual review may be required.",
    "REFERENCE_TEXT_INSUFFICIENT": "The page does not contain enough native PDF text for reliable pdfplumber cross-validation. Manual review may be required.",
    "LOW_TOKEN_COVERAGE": "Low token agreement between Docling and pdfplumber.",
    "MODERATE_TOKEN_COVERAGE": "Moderate token disagreement between Docling and pdfplumber.",
    "TEXT_LENGTH_MISMATCH": "Large difference between Docling and pdfplumber text lengths.",
    "REPLACEMENT_CHARACTERS": "Docling output contains suspicious Unicode replacement characters.",
    "CROSS_PARSER_UNAVAILABLE": "pdfplumber could not enumerate the PDF pages. Docling output cannot be cross-validated using pdfplumber for this document.",
}

NORM = r"trim(regexp_replace(lower({}), '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
PAGE_COUNT = "((length(text) + 1499) // 1500)"

PAIRS = rf"""
slices AS (
  SELECT doc_id, p AS page_number, substr(text, (p - 1) * 1500 + 1, 1500) AS src
  FROM (SELECT doc_id, text, unnest(range(1, {PAGE_COUNT} + 1)) AS p FROM documents)
), pairs AS (
  SELECT doc_id, page_number::INT AS page_number,
    CASE WHEN doc_id % 17 = 3 THEN '' WHEN doc_id % 19 = 4 THEN src[1:40] ELSE src END AS reference_text,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 0 THEN substr(src, 1, 900) WHEN doc_id % 7 = 0 THEN substr(src, 1, 1100)
      WHEN doc_id % 13 = 0 THEN repeat(chr(65533), 20) || src ELSE src END AS primary_text,
    (doc_id * 5 + page_number) % 6 AS kind, (doc_id + page_number) % 4 AS reference_tables, (doc_id * page_number) % 3 AS primary_tables
  FROM slices
), norm AS (
  SELECT *, length(reference_text) AS char_objects, {NORM.format("primary_text")} AS np, {NORM.format("reference_text")} AS nr FROM pairs
), page_counts AS (
  SELECT doc_id, {PAGE_COUNT} AS primary_pages, CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 23 = 0 THEN {PAGE_COUNT} + 1 ELSE {PAGE_COUNT} END AS reference_pages
  FROM documents
), boxes(kind, x0, x1, t, b) AS (
  VALUES (1, 36, 96, 0, 40), (2, 100, 406, 0, 400), (2, 0, 500, 100, 500), (3, 0, 612, 0, 700), (4, 300, 250, 0, 90), (4, 0, 300, 100, 500)
), shares AS (
  SELECT kind, least(greatest(greatest((x1 - x0)::DOUBLE, 0) * greatest((b - t)::DOUBLE, 0) / (612.0::DOUBLE * 792.0::DOUBLE), 0), 1) AS c FROM boxes
), cover AS (
  SELECT kind, max(c) AS largest, least(sum(c), 1.0::DOUBLE) AS total FROM shares GROUP BY kind
), profile AS (
  SELECT n.*, coalesce(largest, 0.0::DOUBLE) AS largest, coalesce(total, 0.0::DOUBLE) AS total,
    CASE WHEN n.kind IN (2, 4) THEN 2 WHEN n.kind = 0 THEN 0 ELSE 1 END AS image_count,
    length(nr) >= 80 AND char_objects >= 20 AS usable FROM norm n LEFT JOIN cover USING (kind)
), typed AS (
  SELECT *, CASE WHEN usable AND largest >= 0.8::DOUBLE THEN 'OCR_TEXT_OVER_IMAGE' WHEN usable AND largest >= 0.2::DOUBLE THEN 'MIXED'
    WHEN usable THEN 'DIGITAL' WHEN largest >= 0.8::DOUBLE THEN 'SCANNED_OR_IMAGE_BASED' ELSE 'LOW_TEXT_OR_UNKNOWN' END AS page_type FROM profile
)
"""
COVERAGE = rf"""
tok AS (
  SELECT doc_id, page_number, t, sum(a) AS a, sum(b) AS b FROM (
    SELECT doc_id, page_number, unnest(regexp_extract_all(np, '{TOK}')) AS t, 1 AS a, 0 AS b FROM norm
    UNION ALL SELECT doc_id, page_number, unnest(regexp_extract_all(nr, '{TOK}')), 0, 1 FROM norm
  ) GROUP BY ALL
), met AS (
  SELECT doc_id, page_number, sum(least(a, b))::DOUBLE AS m, sum(b)::DOUBLE AS r FROM tok GROUP BY ALL
), covered AS (
  SELECT n.doc_id, n.page_number, CASE WHEN r > 0 THEN m / r END AS coverage FROM norm n LEFT JOIN met USING (doc_id, page_number)
)
"""


def _issue(code: str, when: str, idx: int, kind: str = "warning", message: str | None = None) -> str:
    text = message or "'" + MESSAGES[code].replace("'", "''") + "'"
    return f"SELECT doc_id, page_number, {idx} AS ord, '{kind}' AS severity, '{code}' AS code, {text} AS message FROM metric WHERE {when}"


VERDICT = "metric AS (\n" + r"""
  SELECT t.*, c.coverage AS cov, CASE WHEN usable AND greatest(length(np), length(nr)) > 0 THEN least(length(np), length(nr))::DOUBLE / greatest(length(np), length(nr))::DOUBLE END AS ratio,
    CASE WHEN length(primary_text) > 0 THEN (length(primary_text) - length(replace(primary_text, chr(65533), '')))::DOUBLE / length(primary_text)::DOUBLE ELSE 0.0::DOUBLE END AS bad
  FROM typed t JOIN covered c USING (doc_id, page_number)
), issue AS (
""" + "\n  UNION ALL ".join([
    _issue("OCR_CROSS_VALIDATION_UNAVAILABLE", "page_type = 'SCANNED_OR_IMAGE_BASED'", 0),
    _issue("DOCLING_OCR_OUTPUT_EMPTY", "page_type = 'SCANNED_OR_IMAGE_BASED' AND length(np) = 0", 1),
    _issue("REFERENCE_TEXT_INSUFFICIENT", "page_type <> 'SCANNED_OR_IMAGE_BASED' AND NOT usable", 0),
    _issue("DOCLING_EMPTY_REFERENCE_NONEMPTY", "usable AND length(nr) >= 100 AND length(np) = 0", 0, "critical", "'Docling extracted no text while pdfplumber found ' || length(nr) || ' characters.'"),
    _issue("LOW_TOKEN_COVERAGE", "usable AND cov < 0.6::DOUBLE", 1, "critical"),
    _issue("MODERATE_TOKEN_COVERAGE", "usable AND cov >= 0.6::DOUBLE AND cov < 0.85::DOUBLE", 1),
    _issue("TEXT_LENGTH_MISMATCH", "ratio < 0.7::DOUBLE", 2),
    _issue("REPLACEMENT_CHARACTERS", "usable AND bad > 0.005::DOUBLE", 3),
    _issue("TABLE_MISSED_BY_DOCLING", "usable AND reference_tables > 0 AND primary_tables = 0", 4, "warning", "'pdfplumber detected ' || reference_tables || ' table(s), while Docling detected none.'"),
]) + r"""
), listed AS (
  SELECT doc_id, page_number, string_agg(code, ',' ORDER BY ord) AS codes, bool_or(severity = 'critical') AS critical FROM issue GROUP BY ALL
), verdict AS (
  SELECT m.*, coalesce(codes, '') AS codes,
    CASE WHEN page_type = 'SCANNED_OR_IMAGE_BASED' THEN 'UNAVAILABLE' WHEN NOT usable THEN 'INSUFFICIENT_REFERENCE' ELSE 'AVAILABLE' END AS cross_validation,
    CASE WHEN NOT usable THEN 'REVIEW' WHEN critical THEN 'FAIL' WHEN codes IS NOT NULL THEN 'REVIEW' ELSE 'PASS' END AS status
  FROM metric m LEFT JOIN listed USING (doc_id, page_number)
)
"""
TABLES = r"""
primary_table AS (
  SELECT doc_id, page_number * 10 + k AS table_index, CASE WHEN (doc_id + page_number * 10 + k) % 10 <> 0 THEN page_number END AS page_no
  FROM (SELECT doc_id, page_number, unnest(range(1, primary_tables + 1)) AS k FROM pairs)
), table_count AS (
  SELECT doc_id, page_no AS page_number, count(*) AS n FROM primary_table WHERE page_no IS NOT NULL GROUP BY ALL
), table_total AS (
  SELECT doc_id, count(*) AS total_tables, count(*) FILTER (page_no IS NULL) AS tables_without_page FROM primary_table GROUP BY ALL
)
"""


def _half_even(c: str) -> str:
    """Mean of whole numbers of ten-thousandths, to a whole number of them, ties to even."""
    s, n = f"{c}_sum", f"{c}_n"
    return f"(({s} // {n}) + CASE WHEN 2 * ({s} % {n}) > {n} OR (2 * ({s} % {n}) = {n} AND ({s} // {n}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 10000.0::DOUBLE"


DOCS = r"""
page AS (
  SELECT v.* FROM verdict v JOIN page_counts c USING (doc_id) WHERE page_number <= least(primary_pages, reference_pages)
), sums AS (
  SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'PASS') AS pass_pages, count(*) FILTER (status = 'REVIEW') AS review_pages,
    count(*) FILTER (status = 'FAIL') AS failed_pages, list_sort(list_distinct(list(page_type) FILTER (page_type <> 'LOW_TEXT_OR_UNKNOWN'))) AS kinds,
    sum(round(round_even(CASE WHEN usable THEN cov END, 4) * 10000)::BIGINT) AS cov_sum, count(CASE WHEN usable THEN cov END) AS cov_n,
    sum(round(round_even(ratio, 4) * 10000)::BIGINT) AS ratio_sum, count(ratio) AS ratio_n
  FROM page GROUP BY doc_id
), doc AS (
  SELECT c.doc_id, reference_pages > 0 AND primary_pages = reference_pages AS page_count_match, coalesce(pass_pages, 0) AS pass_pages,
    coalesce(review_pages, 0) AS review_pages, coalesce(failed_pages, 0) AS failed_pages, """ + _half_even("cov") + " AS average_token_coverage, " + _half_even("ratio") + r""" AS average_character_length_ratio,
    CASE WHEN reference_pages = 0 THEN 'REVIEW' WHEN coalesce(pages, 0) = 0 THEN 'FAIL'
      WHEN failed_pages >= greatest(2, ceil(pages * 0.2::DOUBLE)) THEN 'FAIL' WHEN primary_pages <> reference_pages THEN 'REVIEW'
      WHEN failed_pages + review_pages > 0 THEN 'REVIEW' ELSE 'PASS' END AS status,
    CASE WHEN coalesce(len(kinds), 0) = 0 THEN 'UNKNOWN' WHEN kinds = ['DIGITAL'] THEN 'DIGITAL' WHEN kinds = ['OCR_TEXT_OVER_IMAGE'] THEN 'OCR_TEXT_OVER_IMAGE'
      WHEN len(list_filter(kinds, lambda k: k NOT IN ('SCANNED_OR_IMAGE_BASED', 'OCR_TEXT_OVER_IMAGE'))) = 0 THEN 'SCANNED_OR_IMAGE_BASED' ELSE 'MIXED' END AS document_type,
    coalesce(total_tables, 0) AS total_tables, coalesce(tables_without_page, 0) AS tables_without_page, reference_pages
  FROM page_counts c LEFT JOIN sums USING (doc_id) LEFT JOIN table_total USING (doc_id)
)
"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"


P, C, V, T, D = PAIRS, COVERAGE, VERDICT, TABLES, DOCS
CELLS = r"""
cell AS (
  SELECT n_regionkey, n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN [n_name, NULL] WHEN n_nationkey % 5 = 1 THEN [' a' || chr(10) || n_name]
    ELSE [n_name || '|x', n_nationkey::VARCHAR, chr(9) || 'end '] END AS r FROM nation WHERE n_nationkey % 7 <> 6
), rows AS (
  SELECT n_regionkey, k, list_transform(r, lambda c: coalesce(trim(regexp_replace(c, '\s+', ' ', 'g')), '')) AS r FROM cell
)
"""
BOX = "CASE WHEN l_orderkey % 10 <> 3 THEN {} END"
ORACLES = {
    "str_normalize": f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents",
    "str_tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({NORM.format('text')}, '{TOK}')) AS token FROM documents) GROUP BY token",
    "str_char_ratio": _with(P) + "SELECT doc_id, page_number, CASE WHEN greatest(length(np), length(nr)) > 0 THEN round_even(least(length(np), length(nr))::DOUBLE / greatest(length(np), length(nr)), 4) END AS ratio FROM norm",
    "str_replacement_ratio": _with(P) + "SELECT doc_id, page_number, CASE WHEN length(primary_text) > 0 THEN round_even((length(primary_text) - length(replace(primary_text, chr(65533), '')))::DOUBLE / length(primary_text), 6) ELSE 0.0::DOUBLE END AS ratio FROM pairs",
    "str_output_path": "SELECT doc_id, 'dir.v' || (doc_id % 7) || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '.v1' ELSE '' END AS path FROM documents",
    "str_messages": "SELECT conv_id, turn, role || ': ' || text AS error, role AS value FROM conversations",
    "doc_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "doc_exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "agg_token_coverage": _with(P, C) + "SELECT doc_id, page_number, round_even(coverage, 4) AS coverage FROM covered",
    "agg_token_coverage_shuffle": _with(P, C) + "SELECT doc_id, page_number, round_even(coverage, 4) AS coverage FROM covered",
    "geo_image_coverage": _with(P) + "SELECT doc_id, page_number, round_even(largest, 4) AS largest, round_even(total, 4) AS total, image_count FROM profile",
    "geo_points_to_bbox": "SELECT l_orderkey, l_linenumber, " + ", ".join(BOX.format(f"{f}({a}, {b}, {c})") + f" AS {n}" for f, a, b, c, n in (("least", "l_quantity", "l_discount", "l_tax", "x0"), ("least", "l_discount", "l_tax", "l_quantity", "y0"), ("greatest", "l_quantity", "l_discount", "l_tax", "x1"), ("greatest", "l_discount", "l_tax", "l_quantity", "y1"))) + " FROM lineitem",
    "geo_xywh_to_bbox": "SELECT l_orderkey, l_linenumber, " + ", ".join(BOX.format(x) + f" AS {n}" for x, n in (("l_quantity", "x0"), ("l_discount", "y0"), ("l_quantity + l_tax", "x1"), ("l_discount + (l_quantity + l_discount)", "y1"))) + " FROM lineitem",
    "cls_page_type": _with(P) + "SELECT doc_id, page_number, page_type, usable FROM typed",
    "val_page_issues": _with(P, C, V) + "SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) - 1)::INT AS idx, severity, code, message FROM issue",
    "val_page_status": _with(P, C, V) + "SELECT doc_id, page_number, cross_validation, status, codes FROM verdict",
    "agg_table_counts": _with(P, T) + "SELECT doc_id, page_number, n AS primary_tables FROM table_count",
    "agg_tables_unassigned": _with(P, T) + "SELECT doc_id, total_tables, tables_without_page FROM table_total",
    "jon_page_alignment": _with(P, T) + "SELECT doc_id, page_number, length(primary_text) AS primary_length, length(reference_text) AS reference_length, coalesce(n, 0) AS primary_tables FROM pairs JOIN page_counts USING (doc_id) LEFT JOIN table_count USING (doc_id, page_number) WHERE page_number <= least(primary_pages, reference_pages)",
    "jon_fourway_pages": "SELECT * FROM (SELECT conv_id AS doc_id, turn + 1 AS page_number, CASE WHEN (turn + 1) % 5 <> 0 THEN text ELSE '' END AS text, CASE WHEN (turn + 1) % 5 <> 1 THEN '# ' || text END AS markdown, CASE WHEN (turn + 1) % 5 <> 2 THEN role || ': ' || text END AS items, CASE WHEN (turn + 1) % 5 <> 3 THEN role END AS metadata FROM conversations)",
    "agg_doc_status": _with(P, C, V, T, D) + "SELECT doc_id, page_count_match, pass_pages, review_pages, failed_pages, status FROM doc",
    "agg_doc_type": _with(P, C, V, T, D) + "SELECT doc_id, CASE WHEN reference_pages = 0 THEN 'UNKNOWN' ELSE document_type END AS document_type FROM doc",
    "agg_doc_summary": _with(P, C, V, T, D) + "SELECT doc_id, average_token_coverage, average_character_length_ratio, total_tables, tables_without_page FROM doc",
    "val_document_issues": _with(P) + f"SELECT doc_id, 'warning' AS severity, 'CROSS_PARSER_UNAVAILABLE' AS code, '{MESSAGES['CROSS_PARSER_UNAVAILABLE']}' AS message FROM page_counts WHERE reference_pages = 0",
    "agg_corpus_summary": _with(P, C, V, T, D) + "SELECT count(*) AS total_documents, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status NOT IN ('PASS', 'REVIEW')) AS fail FROM doc",
    "agg_doc_fulltext": "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id",
    "agg_dense_pages": "WITH e AS (SELECT conv_id AS doc_id, turn, turn + 1 AS page_number, text FROM conversations WHERE turn % 3 <> 1), s AS (SELECT doc_id, unnest(range(1, max(page_number) + 1)) AS page_number FROM e GROUP BY doc_id), t AS (SELECT doc_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text FROM e GROUP BY ALL) SELECT doc_id, page_number::INT AS page_number, coalesce(text, '') AS text FROM s LEFT JOIN t USING (doc_id, page_number)",
    "arr_normalize_rows": _with(CELLS) + "SELECT n_regionkey, string_agg(array_to_string(r, '¦'), '¶' ORDER BY k) AS rows FROM rows GROUP BY n_regionkey",
    "arr_rows_to_markdown": _with(CELLS) + ", w AS (SELECT n_regionkey, max(len(r)) AS w FROM rows GROUP BY ALL), l AS (SELECT n_regionkey, k, w, '| ' || array_to_string(list_transform(list_concat(r, list_transform(range(w - len(r)), lambda x: '')), lambda c: replace(c, '|', '\\|')), ' | ') || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY k) AS i FROM rows JOIN w USING (n_regionkey)) SELECT n_regionkey, string_agg(line || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY i) AS markdown FROM l GROUP BY n_regionkey",
    "arr_html_table_to_rows": "SELECT n_regionkey, 'key¦name¶' || string_agg(n_nationkey || '¦' || n_name || ' & co', '¶' ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey",
    "ord_path_sort": "WITH p AS (SELECT doc_id, source, source || '/' || CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-1' ELSE 'a.b' END || '/f' || doc_id || '.pdf' AS path FROM documents) SELECT doc_id, path, (row_number() OVER (PARTITION BY source ORDER BY string_split(path, '/')))::INT AS number FROM p",
    "ing_status_counts": "SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS successful, count(*) FILTER (doc_id % 7 = 0) AS failed FROM documents",
}


TURNS = "t AS (SELECT 'c' || conv_id AS source_file, turn::INT AS turn, (turn + 1)::INT AS page_number, role, text FROM conversations WHERE conv_id % 10 <> 7)"
ORACLES |= {
    "adp_pages_union": f"WITH {TURNS} SELECT 'docling' AS parser_name, source_file, page_number, text, '# ' || text AS markdown, '' AS metadata FROM t"
    " UNION ALL SELECT 'pdfplumber', source_file, page_number, text, NULL, 'height=792.0,width=612.0' FROM t"
    " UNION ALL SELECT 'pymupdf', source_file, page_number, text, NULL, 'height=792.0,image_count=1,width=612.0' FROM t"
    " UNION ALL SELECT 'unstructured', s.source_file, s.p::INT, CASE WHEN trim(text) <> '' THEN text ELSE '' END, NULL, '' FROM (SELECT source_file, unnest(range(1, max(page_number) FILTER (turn % 6 <> 5) + 1)) AS p FROM t GROUP BY 1) s LEFT JOIN (FROM t WHERE turn % 6 <> 5) u ON u.source_file = s.source_file AND u.page_number = s.p"
    " UNION ALL SELECT 'llamaparse', source_file, page_number, CASE WHEN turn % 4 <> 0 THEN text ELSE '' END, CASE WHEN turn % 4 <> 1 THEN role END, CASE WHEN turn % 4 <> 3 THEN 'n=' || turn ELSE '' END FROM t",
    "adp_elements_union": f"WITH {TURNS} SELECT 'docling' AS parser_name, source_file, turn AS element_index, role AS type, text, CASE WHEN turn % 5 <> 0 THEN page_number END AS page_number, CASE WHEN turn % 5 <> 0 THEN 0.0::DOUBLE END AS x0, CASE WHEN turn % 5 <> 0 THEN 0.0::DOUBLE END AS y0, CASE WHEN turn % 5 <> 0 THEN 9.0::DOUBLE END AS x1, CASE WHEN turn % 5 <> 0 THEN 9.0::DOUBLE END AS y1, 'hierarchy_level=' || turn AS metadata FROM t WHERE turn % 4 <> 0 AND length(text) > 0"
    " UNION ALL SELECT 'pdfplumber', source_file, turn, 'word', role, page_number, 1, 2, 3, 4, '' FROM t"
    " UNION ALL SELECT 'pymupdf', source_file, turn, 'text_block', text, page_number, 1, 2, 3, NULL, 'block_number=' || turn || ',block_type=0' FROM t WHERE turn % 4 < 2 AND trim(text) <> ''"
    " UNION ALL SELECT 'unstructured', source_file, turn, CASE WHEN turn % 4 = 1 THEN 'Table' ELSE 'NarrativeText' END, text, CASE WHEN turn % 6 <> 5 THEN page_number END, CASE WHEN turn % 2 = 0 THEN 1 END, CASE WHEN turn % 2 = 0 THEN 6 END, CASE WHEN turn % 2 = 0 THEN 5 END, CASE WHEN turn % 2 = 0 THEN 8 END, 'lang=eng' FROM t"
    " UNION ALL SELECT 'llamaparse', source_file, 0, CASE WHEN turn % 3 = 1 THEN 'table' ELSE 'text' END, CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE role END, page_number, CASE WHEN turn % 5 <> 2 THEN 1 END, CASE WHEN turn % 5 <> 2 THEN 2 END, CASE WHEN turn % 5 <> 2 THEN 4 END, CASE WHEN turn % 5 <> 2 THEN 6 END, 'item_index=0' || CASE WHEN turn % 2 = 1 THEN ',level=' || turn ELSE '' END FROM t WHERE page_number % 4 <> 0",
    "adp_tables_union": f"WITH {TURNS}, r AS (SELECT *, 'a¦' || role || '¶b' AS rows, '| a | ' || role || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| b |  |' AS md FROM t)"
    " SELECT 'docling' AS parser_name, source_file, turn AS table_index, 'h¦i¶' || rows AS rows, CASE WHEN turn % 5 <> 0 THEN page_number END AS page_number, CASE WHEN turn % 5 <> 0 THEN 0.0::DOUBLE END AS x0, CASE WHEN turn % 5 <> 0 THEN 0.0::DOUBLE END AS y0, CASE WHEN turn % 5 <> 0 THEN 9.0::DOUBLE END AS x1, CASE WHEN turn % 5 <> 0 THEN 9.0::DOUBLE END AS y1, '|h|' AS markdown, '<table/>' AS html FROM r WHERE turn % 2 = 0"
    " UNION ALL SELECT 'pdfplumber', source_file, turn, rows, page_number, 1, 2, 3, 4, md, NULL FROM r WHERE turn % 3 = 0"
    " UNION ALL SELECT 'pymupdf', source_file, turn, rows, page_number, 1, 2, 3, 4, md, NULL FROM r WHERE turn % 3 = 0"
    " UNION ALL SELECT 'unstructured', source_file, turn, role || '¦x|y', CASE WHEN turn % 6 <> 5 THEN page_number END, NULL, NULL, NULL, NULL, '| ' || role || ' | x\\|y |' || chr(10) || '| --- | --- |', '<table><tr><td>' || role || '</td><td>x|y</td></tr></table>' FROM r WHERE turn % 4 = 1"
    " UNION ALL SELECT 'llamaparse', source_file, 0, rows, page_number, CASE WHEN turn % 5 <> 2 THEN 1 END, CASE WHEN turn % 5 <> 2 THEN 2 END, CASE WHEN turn % 5 <> 2 THEN 4 END, CASE WHEN turn % 5 <> 2 THEN 6 END, role, NULL FROM r WHERE turn % 3 = 1 AND page_number % 4 <> 0",
}

LENGTHS = (
    f"WITH {TURNS.replace(' WHERE conv_id % 10 <> 7', '')}, f AS (SELECT source_file, NOT ends_with(source_file, '7') AS ok, count(*) AS n, sum(length(text)) + 2 * (count(*) - 1) AS whole,"
    " coalesce(sum(length(text)) FILTER (length(text) > 0) + 2 * (count(*) FILTER (length(text) > 0) - 1), 0) AS filled, max(page_number) FILTER (turn % 6 <> 5) AS last,"
    " sum(length(text)) FILTER (turn % 4 <> 0) + 2 * (count(*) FILTER (turn % 4 <> 0) - 1) AS saved, sum(length(role)) FILTER (turn % 4 <> 1) + 2 * (count(*) FILTER (turn % 4 <> 1) - 1) AS marked FROM t GROUP BY 1)"
)
COUNTED = {
    "docling": ("n", "count(*) FILTER (turn % 4 <> 0 AND length(text) > 0)", "count(*) FILTER (turn % 2 = 0)", "text", "turn = 0"),
    "pdfplumber": ("n", "count(*)", "count(*) FILTER (turn % 3 = 0)", "text", "turn = 0"),
    "pymupdf": ("n", "count(*) FILTER (turn % 4 < 2 AND trim(text) <> '')", "count(*) FILTER (turn % 3 = 0)", "text", "turn = 0"),
    "unstructured": ("max(page_number) FILTER (turn % 6 <> 5)", "count(*)", "count(*) FILTER (turn % 4 = 1)", "CASE WHEN trim(text) <> '' AND turn % 6 <> 5 THEN text ELSE '' END", "turn = 0"),
    "llamaparse": ("n", "count(*) FILTER (page_number % 4 <> 0)", "count(*) FILTER (turn % 3 = 1 AND page_number % 4 <> 0)", "CASE WHEN turn % 4 <> 0 THEN text ELSE '' END", "turn = 0"),
}


def _counted(name: str, pages: str, elements: str, tables: str, text: str, first: str) -> str:
    pages = "count(*)" if pages == "n" else f"coalesce({pages}, 0)"
    return (
        f"SELECT '{name}' AS parser_name, source_file, ok AS success, CASE WHEN NOT ok THEN 'ValueError: broken' END AS error, CASE WHEN ok THEN {pages} ELSE 0 END AS pages, CASE WHEN ok THEN {elements} ELSE 0 END AS elements, CASE WHEN ok THEN {tables} ELSE 0 END AS tables,"
        f" CASE WHEN ok THEN max(CASE WHEN {first} THEN {text} END) END AS first, CASE WHEN ok THEN sum(length({text}))::BIGINT ELSE 0 END AS characters FROM (SELECT *, NOT ends_with(source_file, '7') AS ok FROM t) GROUP BY source_file, ok"
    )


_FAILED = "CASE WHEN NOT ok THEN 'ValueError: broken' END AS error FROM f"
ORACLES |= {
    "adp_results": LENGTHS
    + " SELECT 'docling' AS parser_name, source_file, ok AS success, CASE WHEN ok THEN 5 ELSE 0 END AS text_length, CASE WHEN ok THEN 7 END AS markdown_length, CASE WHEN ok THEN 'conversion_status=success,document_name=doc,page_count=' || n ELSE '' END AS metadata, " + _FAILED
    + " UNION ALL SELECT 'pdfplumber', source_file, ok, CASE WHEN ok THEN whole::BIGINT ELSE 0 END, NULL, CASE WHEN ok THEN 'page_count=' || n ELSE '' END, " + _FAILED
    + " UNION ALL SELECT 'pymupdf', source_file, ok, CASE WHEN ok THEN whole::BIGINT ELSE 0 END, NULL, CASE WHEN ok THEN 'page_count=' || n ELSE '' END, " + _FAILED
    + " UNION ALL SELECT 'unstructured', source_file, ok, CASE WHEN ok THEN filled::BIGINT ELSE 0 END, NULL, CASE WHEN ok THEN 'element_count=' || n || ',languages=eng,page_count=' || coalesce(last, 0) || ',strategy=hi_res' ELSE '' END, " + _FAILED
    + " UNION ALL SELECT 'llamaparse', source_file, ok, CASE WHEN ok THEN coalesce(saved, 0)::BIGINT ELSE 0 END, CASE WHEN ok THEN marked::BIGINT END, CASE WHEN ok THEN 'page_count=' || n || ',tier=agentic' ELSE '' END, " + _FAILED,
    "adp_results_json": f"WITH {TURNS.replace(' WHERE conv_id % 10 <> 7', '')} " + " UNION ALL ".join(_counted(k, *v) for k, v in COUNTED.items()),
    "json_report_export": _with(P, C, V, T, D, "listed_pages AS (SELECT doc_id, string_agg(page_number || ':' || status || ':' || replace(codes, ',', '+'), ',' ORDER BY page_number) AS pages FROM page GROUP BY doc_id)")
    + "SELECT d.doc_id, d.doc_id::VARCHAR AS source_file, CASE WHEN c.reference_pages = 0 THEN 'UNKNOWN' ELSE document_type END AS document_type, status, c.primary_pages AS docling, c.reference_pages AS pdfplumber, page_count_match AS match, pass_pages, failed_pages, average_token_coverage, total_tables AS docling_total_tables, CASE WHEN c.reference_pages = 0 THEN 'CROSS_PARSER_UNAVAILABLE' ELSE '' END AS issues, coalesce(pages, '') AS pages, average_token_coverage IS NULL AS null_coverage FROM doc d JOIN page_counts c USING (doc_id) LEFT JOIN listed_pages USING (doc_id)",
    "pip_validation": _with(P, T, C, V.replace("primary_tables = 0", "NOT EXISTS (FROM table_count k WHERE k.doc_id = metric.doc_id AND k.page_number = metric.page_number)"), D, "s AS (SELECT *, CASE WHEN doc_id % 31 = 5 THEN 'Source PDF not found: d/' || doc_id || '.pdf' WHEN doc_id % 29 = 7 THEN 'Parsed document not found: d/' || doc_id WHEN doc_id % 37 = 11 THEN 'ValueError: torn' END AS e FROM doc LEFT JOIN (SELECT doc_id, pages FROM sums) USING (doc_id))")
    + "SELECT 'd/' || doc_id AS directory, CASE WHEN e IS NOT NULL THEN 'FAIL' ELSE status END AS status, e AS error_message, CASE WHEN e IS NULL THEN CASE WHEN reference_pages = 0 THEN 'UNKNOWN' ELSE document_type END END AS document_type, CASE WHEN e IS NULL AND pages > 0 THEN pages END AS pages, CASE WHEN e IS NULL THEN pass_pages END AS pass_pages, CASE WHEN e IS NULL THEN total_tables END AS total_tables FROM s",
    "src_check_sources": "SELECT 'raw/' || doc_id AS directory, CASE WHEN doc_id % 5 = 1 OR doc_id % 7 = 2 THEN 'FAIL' END AS early_status, CASE WHEN doc_id % 5 = 1 THEN 'Source PDF not found: raw/' || doc_id || '.pdf' WHEN doc_id % 7 = 2 THEN 'Parsed document not found: raw/' || doc_id END AS error_message FROM documents WHERE doc_id % 3 <> 0",
    "src_new_files": "SELECT doc_id::VARCHAR AS relative_path, length(text) AS length, sha256(text) AS sha256 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "snk_artifacts": "SELECT doc_id::VARCHAR AS directory, f AS file_name, CASE f WHEN 'document.json' THEN '' WHEN 'document.md' THEN sha256('# ' || text) WHEN 'document.txt' THEN sha256(text) WHEN 'metadata.json' THEN doc_id || '.pdf|' || sha256(text) || '|docling|2' ELSE doc_id || '.pdf|docling|failed|ValueError|torn' END AS kept FROM (SELECT doc_id, text, unnest(CASE WHEN doc_id % 6 = 1 THEN ['error.json'] ELSE ['document.json', 'document.md', 'document.txt', 'metadata.json'] END) AS f FROM documents)",
    "set_dedupe_glyphs": "WITH g AS (SELECT l_orderkey % 50 AS page, l_returnflag AS t, l_linestatus AS f, floor(l_quantity::DOUBLE * 3 + l_discount::DOUBLE * 10) AS x0, (l_linenumber * 2)::DOUBLE AS top FROM lineitem), s AS (SELECT *, coalesce(x0 - lag(x0) OVER (PARTITION BY page, t, f, top ORDER BY x0) > 1, true) AS opens FROM g) SELECT page, count(*) AS glyphs, sum(x0) AS x0 FROM s WHERE opens GROUP BY page",
    "ord_reading": "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_quantity::DOUBLE + l_linenumber / 100) - 1)::INT AS \"order\" FROM lineitem",
    "lim_previews": "SELECT doc_id, (i - 1)::INT AS word_index, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 20) + 1)) AS i FROM (SELECT doc_id, string_split(" + NORM.format("text").replace("lower(text)", "text") + ", ' ') AS w FROM documents))",
    "str_nfkc": "SELECT * FROM (VALUES (1, 'file 1'), (2, 'ab c'), (3, chr(233)), (4, '1' || chr(8260) || '2 ' || chr(969)), (5, 'plain'), (6, ''), (7, chr(7785) || ' ' || chr(229))) AS v(k, normalized)",
}
