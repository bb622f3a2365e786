"""Queries: documents, sections, notes and dictionaries."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import text as tx
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query
from ledgerloom.sources import archives as ar
from ledgerloom.sources import dictionary as dic
from ledgerloom.sources import documents as dc

LT = o.strip("text")


@query("a01_archive_elements", ["pages"])
def _a01(pages):
    return ar.read_elements(pages, "page_id", "html")


@query("a02_body_elements", ["pages"])
def _a02(pages):
    return ar.body_elements(ar.read_elements(pages, "page_id", "html"))


def _zipped(batches):
    """Wrap pages as archives; some lose their main part, some are no archives."""
    for b in batches:
        out = []
        for k, html in zip(b["page_id"], b["html"]):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                if k % 5 != 1:
                    z.writestr("word/document.xml", "<doc><p>ok</p></doc>" if k % 5 != 2 else html)
                z.writestr("note.txt", html)
            out.append((k, raw.getvalue() if k % 5 != 3 else html.encode()))
        yield pd.DataFrame(out, columns=["page_id", "content"])


@query("p06_archive_validity", ["pages"], """
SELECT CAST(page_id AS VARCHAR) AS doc_id, page_id % 5 IN (0, 4) AS valid, CAST(CASE page_id % 5 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS entries,
 CASE page_id % 5 WHEN 1 THEN 'missing word/document.xml' WHEN 2 THEN 'not well formed' WHEN 3 THEN 'not a zip archive' END AS problem FROM pages""")
def _p06(pages):
    files = pages.select("page_id", "html").mapInPandas(_zipped, "page_id bigint, content binary")
    return ar.check_archives(files, "page_id").withColumn("problem", F.regexp_replace("problem", ":.*", ""))


@query("a03_document_type", ["docs"], "SELECT doc_id, CASE WHEN contains(doc_name, '연결') THEN 'consolidated' ELSE 'separate' END AS doc_type FROM docs")
def _a03(docs):
    return docs.select("doc_id", dc.document_type("doc_name").alias("doc_type"))


def _elems(pe):
    return pe.withColumnRenamed("page_id", "doc_id")


ET = o.strip("text")
SQ = rf"regexp_replace({ET}, '\s+', ' ', 'g')"


@query("a04_company_name", ["page_elems"], f"""
SELECT page_id AS doc_id, COALESCE(arg_min({SQ}, seq) FILTER (tag = 'b' AND {ET} <> ''), arg_min({SQ}, seq) FILTER (tag = 'a' AND {ET} <> '' AND regexp_matches(attrs, 'href="/[A-E]') AND (contains({ET}, 'la') OR length({ET}) > 3)),
  arg_min({SQ}, seq) FILTER (tag = 'p' AND {ET} <> '' AND contains({ET}, 'la') AND length({ET}) < 50)) AS company FROM page_elems GROUP BY page_id""")
def _a04(pe):
    return dc.company_name(_elems(pe), name_tag="b", cell_tag="a", cell_mark='href="/[A-E]', marker="la")


@query("a05_report_years", ["orders"], """
SELECT o_custkey, CAST(y[1] AS VARCHAR) AS period_current, CAST(COALESCE(y[2], y[1] - 1) AS VARCHAR) AS period_prior
FROM (SELECT o_custkey, list_reverse_sort(list(DISTINCT year(o_orderdate))) AS y FROM orders GROUP BY o_custkey) q""")
def _a05(orders):
    return dc.report_years(orders.withColumn("y0", F.year("o_orderdate")), ["o_custkey"], "y0")


LEGAL = "COALESCE(" + ", ".join(
    f"CASE WHEN contains(lower(t), '{s}') THEN rtrim(trim(substring(t, 1, strpos(lower(t), '{s}') + {len(s)} - 1)), ',') END" for s in dc.COMPANY_SUFFIXES) + ")"


@query("a06_template_metadata", ["tpl_lines"], rf"""
WITH h AS (SELECT doc_id, seq, style, {LT} AS t, file_name FROM tpl_lines),
 c AS (SELECT doc_id, arg_min(COALESCE({LEGAL}, t), seq) AS company FROM h WHERE ({LEGAL} IS NOT NULL OR (style = 'Normal' AND t <> '' AND length(t) < 80 AND t NOT LIKE '(%')) GROUP BY doc_id),
 p AS (SELECT doc_id, arg_min(list_sort([CAST(regexp_extract(t, '(?i)December\s+31,\s+([0-9]{{4}})\s+and', 1) AS INT), CAST(regexp_extract(t, '(?i)December\s+31,\s+[0-9]{{4}}\s+and\s+([0-9]{{4}})', 1) AS INT)]), seq) AS y
   FROM h WHERE regexp_matches(t, '(?i)December\s+31,\s+[0-9]{{4}}\s+and\s+[0-9]{{4}}') GROUP BY doc_id),
 ys AS (SELECT doc_id, list_reverse_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(t, '\b20[12][0-9]\b'), lambda z: CAST(z AS INT)))))) AS y FROM h GROUP BY doc_id),
 k AS (SELECT doc_id, bool_or(contains(lower(t), 'consolidated')) AS con, bool_or(contains(lower(t), 'separate')) AS sep, MAX(file_name) AS f FROM h GROUP BY doc_id)
SELECT k.doc_id, COALESCE(c.company, regexp_extract(f, '^([^_ .]*)', 1)) AS company, CASE WHEN con THEN 'consolidated' WHEN sep THEN 'separate' END AS doc_type,
 CAST(COALESCE(p.y[2], ys.y[1]) AS VARCHAR) AS period_current, CAST(CASE WHEN p.y IS NOT NULL THEN p.y[1] ELSE ys.y[2] END AS VARCHAR) AS period_prior
FROM k LEFT JOIN c ON c.doc_id = k.doc_id LEFT JOIN p ON p.doc_id = k.doc_id LEFT JOIN ys ON ys.doc_id = k.doc_id""")
def _a06(lines):
    return dc.template_metadata(lines)


def _open(tag: str) -> str:
    return (f"COALESCE(SUM(CASE tag WHEN '{tag}' THEN 1 WHEN '/{tag}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


@query("a07_split_sections", ["page_elems"], f"""
SELECT page_id AS doc_id, seq, tag, part FROM (SELECT page_id, seq, tag, CASE WHEN {_open('article')} > 0 THEN 'notes' WHEN {_open('body')} > 0 THEN 'statements' END AS part FROM page_elems) q WHERE part IS NOT NULL""")
def _a07(pe):
    return dc.split_sections(_elems(pe), "body", "article").select("doc_id", "seq", "tag", "part")


@query("a08_content_elements", ["page_elems"], f"""
SELECT page_id AS doc_id, seq, tag, text FROM (SELECT *, {_open('nav')} AS a, {_open('footer')} AS b, {_open('head')} AS c FROM page_elems) q
WHERE tag IN ('p', 'h1', 'li', 'table') AND a <= 0 AND b <= 0 AND c <= 0""")
def _a08(pe):
    return dc.content_elements(_elems(pe), ["p", "h1", "li", "table"], ["nav", "footer", "head"]).select("doc_id", "seq", "tag", "text")


@query("a09_segment_notes", ["doc_lines"], rf"""
WITH l AS (SELECT doc_id, seq, {LT} AS t FROM doc_lines),
 p AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]+\.\s+(?s:.)+') THEN 1 WHEN regexp_matches(t, '^[0-9]+\.[0-9]+\.[0-9]+\s+(?s:.)+') THEN 2
   WHEN regexp_matches(t, '^[0-9]+\.[0-9]+\s+(?s:.)+') THEN 3 WHEN regexp_matches(t, '^\([0-9]+\)\s+(?s:.)+') THEN 4 WHEN regexp_matches(t, '^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s*(?s:.)+') THEN 5 ELSE 0 END AS p FROM l WHERE t <> ''),
 s AS (SELECT *, CAST(SUM(CASE WHEN p = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS note_idx FROM p),
 h AS (SELECT doc_id, note_idx, t FROM s WHERE p = 1),
 e AS (SELECT doc_id FROM s WHERE note_idx = 0 GROUP BY doc_id HAVING NOT bool_or(p = 0))
SELECT s.doc_id, s.seq, s.note_idx, COALESCE(regexp_extract(h.t, '^([0-9]+)', 1), '0') AS number, COALESCE({o.strip("regexp_replace(h.t, '^[0-9]+[.][[:space:]]+', '')")}, '(서문)') AS title,
 CASE p WHEN 1 THEN 'title' WHEN 0 THEN 'paragraph' ELSE 'subtitle' END AS elem_type,
 CASE p WHEN 4 THEN regexp_extract(s.t, '^(\([0-9]+\))', 1) WHEN 5 THEN CAST(strpos('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', substring(s.t, 1, 1)) AS VARCHAR) WHEN 2 THEN regexp_extract(s.t, '^([0-9.]*[0-9])', 1) WHEN 3 THEN regexp_extract(s.t, '^([0-9.]*[0-9])', 1) END AS numbering,
 CAST(CASE p WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS BIGINT) AS depth
FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND h.note_idx = s.note_idx WHERE NOT (s.note_idx = 0 AND s.doc_id IN (SELECT doc_id FROM e))""")
def _a09(lines):
    return dc.segment_notes(lines)


FOOT = f"(contains(lower({LT}), 'should be read in conjunction') OR (contains(lower({LT}), 'the above') AND contains(lower({LT}), 'statement')) OR length({LT}) > 120)"


@query("a10_segment_sections", ["tpl_lines"], rf"""
WITH l AS (SELECT doc_id, seq, style, {LT} AS t, lower(style) = 'abctitle' AND {LT} <> '' AND NOT {FOOT} AS opens FROM tpl_lines WHERE NOT (lower(style) = 'abctitle' AND {LT} = '')),
 s AS (SELECT *, CAST(SUM(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_idx FROM l),
 h AS (SELECT doc_id, section_idx, t, regexp_matches(t, '^[0-9]+(\.[0-9]+)*\s*\.?\s+[^\n]+$') AS m FROM s WHERE opens)
SELECT s.doc_id, s.seq, s.section_idx, CASE WHEN s.section_idx = 0 THEN 'preamble' ELSE 'notes' END AS section_type,
 CASE WHEN h.m THEN regexp_extract(h.t, '^([0-9]+(\.[0-9]+)*)', 1) ELSE CASE WHEN h.t IS NOT NULL THEN CAST(h.section_idx AS VARCHAR) END END AS number,
 COALESCE(CASE WHEN h.m THEN {o.strip(r"regexp_extract(h.t, '^[0-9]+(\.[0-9]+)*\s*\.?\s+([^\n]+)$', 2)")} ELSE h.t END, 'Preamble') AS title,
 CASE WHEN s.opens THEN 'title' WHEN lower(s.style) IN ('subtitle', 'aff5') THEN 'subtitle' ELSE 'paragraph' END AS elem_type
FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND h.section_idx = s.section_idx""")
def _a10(lines):
    return dc.segment_sections(lines)


@query("a11_style_match", ["doc_lines"], "SELECT doc_id, seq, lower(style) = 'abctitle' AS is_title, lower(style) IN ('subtitle', 'aff5') AS is_subtitle FROM doc_lines")
def _a11(lines):
    return lines.select("doc_id", "seq", dc.is_title_style("style").alias("is_title"), dc.is_subtitle_style("style").alias("is_subtitle"))


@query("a12_footer", ["tpl_lines"], f"SELECT doc_id, seq, {FOOT} AS is_footer FROM tpl_lines")
def _a12(lines):
    return lines.select("doc_id", "seq", tx.is_statement_footer("text").alias("is_footer"))


@query("a13_statement_tables", ["src_cells"], """
SELECT pair_id AS doc_id, note_no AS table_id, CAST(COUNT(DISTINCT row_idx) AS BIGINT) AS n_rows FROM src_cells
WHERE pair_id % 3 <> 2 AND note_no <> 'SMALL' AND NOT (pair_id % 7 = 1) GROUP BY pair_id, note_no HAVING COUNT(DISTINCT row_idx) >= 5 AND bool_or(contains(text, '단위'))""")
def _a13(cells):
    t = cells.groupBy(F.col("pair_id").alias("doc_id"), F.col("note_no").alias("table_id")).agg(
        F.count_distinct("row_idx").alias("n_rows"), F.max(F.col("text").contains("단위")).alias("has_head"))
    t = t.withColumns({"border": F.when(F.col("doc_id") % 3 != 2, 1).otherwise(0), "in_notes": F.col("table_id") == "SMALL",
                       "section_title": F.when(F.col("doc_id") % 7 == 1, "외부감사 실시내용").otherwise("재무제표")})
    return dc.select_statement_tables(t.unionByName(t)).select("doc_id", "table_id", "n_rows")


@query("a18_period_dates", ["docs"], """
SELECT doc_id, y1 || '.12.31|' || (y1 - 1) || '.0' || (1 + doc_id % 9) || '.05' AS periods FROM docs""")
def _a18(docs):
    text = F.concat("text", F.expr("concat(' 제 1 기 ', y1, '년 12월 31일 현재, ', y1 - 1, '년 ', 1 + doc_id % 9, '월 5일 그리고 ', y1, '년 12월31일')"))
    return docs.select("doc_id", F.array_join(d.korean_dates(text), "|").alias("periods"))


@query("a19_preceding_unit", ["doc_lines"], r"""
SELECT doc_id, seq, last_value(NULLIF(regexp_extract(text, '(\(단위\s*:\s*[^)]+\))', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unit FROM doc_lines""")
def _a19(lines):
    return dc.preceding_unit(lines).select("doc_id", "seq", "unit")


@query("a20_title_context", ["doc_lines"], """
SELECT doc_id, seq, COALESCE(string_agg(NULLIF(trim(text), ''), ' ' ORDER BY seq) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS context FROM doc_lines""")
def _a20(lines):
    return dc.title_context(lines).select("doc_id", "seq", "context")


@query("w08_nearest_paragraph", ["doc_lines"], f"""
SELECT doc_id, seq, last_value(CASE WHEN {LT} <> '' THEN substring({LT}, 1, 60) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM doc_lines""")
def _w08(lines):
    return dc.nearest_paragraph(lines).select("doc_id", "seq", "context")


@query("a28_read_dictionary", ["terms"], "SELECT ko, en FROM terms")
def _a28(terms):
    line = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("| "), "ko", F.lit(" | "), "en", F.lit(" |"))).otherwise(F.concat("ko", F.lit(" → "), "en"))
    heads = terms.select(F.lit("| 한국어 | 영어 |").alias("value"), "ord").unionByName(terms.select(F.lit("|---|---|").alias("value"), "ord"))
    return dic.parse_dictionary(terms.select(line.alias("value"), "ord").unionByName(heads)).select("ko", "en")
