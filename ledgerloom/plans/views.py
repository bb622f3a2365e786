"""Inputs of the registered queries, derived from the given tables.

A company (supplier) files one report per year; a *pair* is the report of year
y (the source) together with the template filled for year y-1.  Each view is
one SQL text used by Spark and by the oracle.  ``[[...]]`` marks the few places
where the two dialects differ.  All rows of the tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import keep_dealt, stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# amount per company, note, row and year, in won
VIEWS["fact"] = """
SELECT l_suppkey AS company, p_type AS note_no,
       CAST(REPLACE(p_brand, 'Brand#', '') AS BIGINT) AS n,
       CAST(YEAR(l_shipdate) AS BIGINT) AS yr,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amt
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_suppkey, p_type, p_brand, YEAR(l_shipdate)"""

# source rows: current = y, prior = y-1; the subtotal row has n NULL
VIEWS["src_items"] = """
SELECT pair_id, note_no, [[level n]],
       CAST(SUM(CASE WHEN k = 0 THEN amt END) AS BIGINT) AS cur_amt,
       CAST(SUM(CASE WHEN k = 1 AND note_no <> 'STANDARD' THEN amt END) AS BIGINT) AS pri_amt
FROM (SELECT[[dealt pair_id]] company * 10000 + yr + k AS pair_id, note_no, n, amt, k FROM fact [[explode k 0 1]]) f
[[subtotals pair_id, note_no; n]]"""

VIEWS["src_rows"] = """
SELECT pair_id, note_no,
       CAST(DENSE_RANK() OVER (PARTITION BY pair_id ORDER BY note_no) AS BIGINT) AS note_seq,
       CAST(0 AS BIGINT) AS table_idx,
       CAST(ROW_NUMBER() OVER (PARTITION BY pair_id, note_no
            ORDER BY CASE WHEN n IS NULL THEN 1 ELSE 0 END, n) AS BIGINT) AS row_idx,
       CASE WHEN n IS NULL THEN '합계' WHEN n % 3 = 2 THEN CONCAT('품목 ', n)
            ELSE CONCAT('Brand#', n) END AS label,
       n, cur_amt, pri_amt,
       CASE WHEN note_no IN ('MEDIUM', 'PROMO') THEN 'thousand' ELSE 'won' END AS unit,
       n IS NULL AS is_total
FROM src_items"""

# template rows in thousands: current = y-1, prior = y-2 (STANDARD: y and y-1);
# LARGE and PROMO carry the two columns swapped, SMALL carries unrelated amounts
VIEWS["tpl_items"] = """
SELECT pair_id, note_no, [[level n]],
       CAST(FLOOR((SUM(CASE WHEN k = 1 THEN amt END) + 500) / 1000) AS BIGINT) AS a1,
       CAST(FLOOR((SUM(CASE WHEN k = 2 THEN amt END) + 500) / 1000) AS BIGINT) AS a2
FROM (SELECT[[dealt pair_id]] company * 10000 + yr + k - CASE WHEN note_no = 'STANDARD' THEN 1 ELSE 0 END AS pair_id,
             note_no, n, amt, k FROM fact [[explode k 1 2]]) f
[[subtotals pair_id, note_no; n]]"""

VIEWS["tpl_base"] = """
SELECT pair_id, note_no,
       CAST(DENSE_RANK() OVER (PARTITION BY pair_id ORDER BY note_no) AS BIGINT) AS note_seq,
       CAST(DENSE_RANK() OVER (PARTITION BY pair_id ORDER BY note_no) AS BIGINT) AS tpl_table,
       CAST(ROW_NUMBER() OVER (PARTITION BY pair_id, note_no
            ORDER BY CASE WHEN n IS NULL THEN 1 ELSE 0 END, n) + 1 AS BIGINT) AS row_idx,
       CASE WHEN n IS NULL THEN 'Total' WHEN n % 3 = 0 THEN CONCAT('BRAND#', n, ' :')
            WHEN n % 3 = 1 THEN CONCAT('Brand#', n, ' net') ELSE CONCAT('Item ', n) END AS label,
       n,
       CASE WHEN note_no IN ('LARGE', 'PROMO') THEN a2 WHEN note_no = 'SMALL' THEN a1 * 3 + 11 ELSE a1 END AS cur_amt,
       CASE WHEN note_no IN ('LARGE', 'PROMO') THEN a1 WHEN note_no = 'SMALL' THEN a2 * 3 + 11 ELSE a2 END AS pri_amt,
       'thousand' AS unit, n IS NULL AS is_total
FROM tpl_items"""

# template with look-alike tables (+100) in which every second amount is off
VIEWS["tpl_rows"] = """
SELECT pair_id, note_no, note_seq, tpl_table + d AS tpl_table, row_idx, label, n,
       CASE WHEN d = 100 AND n % 2 = 0 THEN cur_amt + 7 ELSE cur_amt END AS cur_amt,
       CASE WHEN d = 100 AND n % 2 = 0 THEN pri_amt + 7 ELSE pri_amt END AS pri_amt,
       unit, is_total
FROM tpl_base [[explode d 0 100]]"""

# source cells as text, header row 0, mixed number notations
VIEWS["src_cells"] = """
SELECT pair_id, note_no, row_idx, c AS col_idx,
       CASE WHEN c = 0 THEN label
            WHEN c = 2 THEN CASE WHEN pri_amt IS NULL THEN '' ELSE CAST(pri_amt AS [[str]]) END
            WHEN cur_amt IS NULL THEN '-'
            WHEN cur_amt % 5 = 0 THEN CONCAT('(', [[fmt cur_amt]], ')')
            WHEN cur_amt % 5 = 1 THEN CONCAT('△', cur_amt)
            WHEN cur_amt % 5 = 2 THEN CONCAT('₩', cur_amt)
            ELSE [[fmt cur_amt]] END AS text
FROM src_rows [[explode c 0 1 2]]
UNION ALL
SELECT pair_id, note_no, CAST(0 AS BIGINT), c,
       CASE WHEN c = 0 THEN CASE WHEN note_no IN ('MEDIUM', 'PROMO') THEN '(단위: 천원)' ELSE '(단위: 원)' END
            WHEN c = 1 THEN '당기말' ELSE '전기말' END
FROM (SELECT DISTINCT pair_id, note_no FROM src_rows) t [[explode c 0 1 2]]"""

# template cells: physical columns 0/2/4 of width two, two and one; header rows 0 and 1
VIEWS["tpl_cells"] = """
SELECT pair_id, tpl_table, row_idx, CAST(c / 2 AS BIGINT) AS cell_idx, c AS phys_col,
       CASE WHEN c = 4 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS span,
       CASE WHEN c = 0 THEN label
            WHEN c = 2 THEN CASE WHEN cur_amt IS NULL THEN '-' ELSE [[fmt cur_amt]] END
            ELSE CASE WHEN pri_amt IS NULL THEN '-' ELSE [[fmt pri_amt]] END END AS text
FROM tpl_rows [[explode c 0 2 4]]
UNION ALL
SELECT pair_id, tpl_table, r, CAST(c / 2 AS BIGINT), c,
       CASE WHEN c = 4 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END,
       CASE WHEN r = 0 AND c = 0 THEN '(in thousands of Korean won)'
            WHEN r = 1 AND c = 2 THEN CAST(pair_id % 10000 - 1 AS [[str]])
            WHEN r = 1 AND c = 4 THEN CAST(pair_id % 10000 - 2 AS [[str]]) ELSE '' END
FROM (SELECT DISTINCT pair_id, tpl_table FROM tpl_rows) t [[explode r 0 1]] [[explode c 0 2 4]]"""

# rows known to belong together, with the expected amounts in thousands
VIEWS["row_pairs"] = """
SELECT s.pair_id, s.note_no, s.note_seq, s.row_idx AS src_row, t.tpl_table, t.row_idx AS tpl_row,
       s.label AS src_label, t.label AS tpl_label, s.n, s.is_total, s.unit,
       s.cur_amt AS src_cur, s.pri_amt AS src_pri,
       CAST(FLOOR((s.cur_amt + 500) / 1000) AS BIGINT) AS exp_cur,
       CAST(FLOOR((s.pri_amt + 500) / 1000) AS BIGINT) AS exp_pri,
       t.cur_amt AS tpl_cur, t.pri_amt AS tpl_pri
FROM src_rows s JOIN tpl_base t
  ON s.pair_id = t.pair_id AND s.note_no = t.note_no AND COALESCE(s.n, -1) = COALESCE(t.n, -1)"""

# filled cells with injected faults (swap, blank, sign, factor, prior in current)
VIEWS["filled"] = """
SELECT pair_id, note_no, note_seq, src_row, tpl_table, tpl_row, src_label, tpl_label, is_total, exp_cur, exp_pri,
       CASE f WHEN 0 THEN CASE WHEN exp_pri IS NULL THEN '-' ELSE [[fmt exp_pri]] END
              WHEN 1 THEN '' WHEN -1 THEN '-' WHEN 2 THEN CONCAT('(', [[fmt exp_cur]], ')')
              WHEN 3 THEN [[fmt exp_cur * 1000]] WHEN 4 THEN [[fmt COALESCE(exp_pri, 77)]]
              ELSE CASE WHEN exp_cur IS NULL THEN '-' ELSE [[fmt exp_cur]] END END AS cur_text,
       CASE f WHEN 0 THEN CASE WHEN exp_cur IS NULL THEN '-' ELSE [[fmt exp_cur]] END
              ELSE CASE WHEN exp_pri IS NULL THEN '-' ELSE [[fmt exp_pri]] END END AS pri_text
FROM (SELECT row_pairs.*, CASE WHEN pair_id % 4 = 0 AND note_no = 'ECONOMY' THEN 0
        WHEN exp_cur IS NULL AND (pair_id * 7 + tpl_row * 3 + note_seq) % 11 IN (2, 3) THEN -1
        ELSE (pair_id * 7 + tpl_row * 3 + note_seq) % 11 END AS f FROM row_pairs) x"""

# source cells as they came out: some blanked, some off by one (tolerated) or five
VIEWS["out_cells"] = """
SELECT pair_id, note_no, row_idx, c AS col_idx,
       CASE WHEN c = 0 THEN label WHEN row_idx % 7 = 3 OR a IS NULL THEN ''
            WHEN row_idx % 11 = 5 THEN [[fmt a + 5]] WHEN row_idx % 5 = 2 THEN [[fmt a + 1]] ELSE [[fmt a]] END AS text
FROM (SELECT pair_id, note_no, row_idx, c, label, CASE WHEN c = 1 THEN cur_amt ELSE pri_amt END AS a
      FROM src_rows [[explode c 0 1 2]]) x"""

# notes of both sides; in some pairs the template is numbered backwards or titled differently
VIEWS["src_notes"] = """
SELECT pair_id, note_no AS note_id, note_seq,
       CASE WHEN pair_id % 2 = 0 THEN CONCAT(note_seq, '.') ELSE CONCAT('0', note_seq) END AS number,
       CONCAT(note_seq, '. 주석 ', LOWER(note_no), '품') AS title,
       CAST(COUNT(*) AS BIGINT) AS n_rows
FROM src_rows GROUP BY pair_id, note_no, note_seq"""

VIEWS["tpl_notes"] = """
SELECT pair_id, note_no AS note_id, note_seq,
       CASE WHEN pair_id % 5 = 2 THEN CAST(7 - note_seq AS [[str]]) ELSE CAST(note_seq AS [[str]]) END AS number,
       CASE WHEN pair_id % 5 = 1 THEN 'General matters'
            WHEN pair_id % 5 = 3 THEN CONCAT('Notes on ', LOWER(note_no), ' goods')
            ELSE CONCAT(LOWER(note_no), ' ', REVERSE(LOWER(note_no))) END AS title,
       CAST(COUNT(*) AS BIGINT) AS n_rows
FROM tpl_base GROUP BY pair_id, note_no, note_seq"""

# note titles in both languages
VIEWS["title_map"] = """
SELECT ko, en, CAST(ROW_NUMBER() OVER (ORDER BY ko) AS BIGINT) AS ord FROM (
  SELECT DISTINCT CONCAT('주석 ', LOWER(p_type), '품') AS ko,
         CONCAT(LOWER(p_type), ' ', REVERSE(LOWER(p_type))) AS en FROM part) t"""

# row-label terms in both languages
VIEWS["terms"] = """
SELECT ko, en, CAST(ROW_NUMBER() OVER (ORDER BY ko) AS BIGINT) AS ord FROM (
  SELECT DISTINCT CONCAT('품목 ', REPLACE(p_brand, 'Brand#', '')) AS ko,
         CONCAT('Item ', REPLACE(p_brand, 'Brand#', '')) AS en FROM part) t"""

# documents with period sentences, markers, style and Korean document names
VIEWS["docs"] = """
SELECT doc_id, lang, source, CAST(2020 + doc_id % 4 AS BIGINT) AS y1,
       CONCAT(text, ' December 31, ', 2020 + doc_id % 4, ' and ', 2019 + doc_id % 4,
              CASE WHEN doc_id % 7 = 0 THEN ' [NEEDS_TRANSLATION: 매출액]' ELSE '' END) AS text,
       CASE WHEN doc_id % 3 = 0 THEN '연결재무제표' WHEN doc_id % 3 = 1 THEN '별도재무제표'
            ELSE '감사보고서' END AS doc_name
FROM documents"""

# paragraphs with numbering and unit markers
VIEWS["doc_lines"] = """
SELECT doc_id, CAST(seq AS BIGINT) AS seq,
       CASE WHEN (seq + doc_id) % 5 = 0 THEN 'ABCTitle' WHEN seq % 4 = 1 THEN 'aff5' ELSE 'Normal' END AS style,
       CASE WHEN (seq + doc_id) % 5 = 0 THEN CONCAT(CAST(FLOOR((seq + doc_id % 5) / 5) AS BIGINT) + 1, '. ', line)
            WHEN seq % 7 = 0 THEN CONCAT('(단위 : 천원) ', line)
            WHEN seq % 11 = 0 THEN CONCAT('(', seq, ') ', line)
            WHEN seq % 13 = 0 THEN CONCAT('⑫ ', line)
            WHEN seq % 17 = 0 THEN '   ' ELSE line END AS text
FROM [[doclines]]"""

# template paragraphs with company, type and period sentences
VIEWS["tpl_lines"] = """
SELECT doc_id, seq, style,
       CASE WHEN seq = 2 AND doc_id % 3 = 0 THEN CONCAT('Group ', doc_id, ' Co., Ltd. and its subsidiaries')
            WHEN seq = 3 AND doc_id % 2 = 0 THEN 'Consolidated financial statements'
            WHEN seq = 4 AND doc_id % 4 < 3 THEN CONCAT('As of December 31, ', 2020 + doc_id % 4, ' and ', 2019 + doc_id % 4)
            WHEN seq = 4 THEN 'Events of 2017 and 2018' WHEN seq = 5 THEN 'The above statements should be read in conjunction with the notes.'
            ELSE text END AS text,
       CONCAT('Firm', doc_id, '_2024 report.docx') AS file_name
FROM doc_lines"""

# elements of raw pages: one row per tag, in document order
VIEWS["page_elems"] = """
SELECT page_id, seq, LOWER([[re_extract piece ^(/?[A-Za-z0-9]+) 1]]) AS tag,
       [[re_extract piece ^/?[A-Za-z0-9]+([^>]*)> 1]] AS attrs,
       [[re_extract piece ^/?[A-Za-z0-9]+[^>]*>([^<]*) 1]] AS text
FROM [[pagepieces]] WHERE seq > 0"""

# cells with spans: about thirty cells over seven rows per table
VIEWS["grid"] = """
SELECT table_id, row_idx,
       CAST(ROW_NUMBER() OVER (PARTITION BY table_id, row_idx
            ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS cell_idx,
       span, rowspan, vmerge, text
FROM (SELECT CAST(FLOOR(l_orderkey / 8) AS BIGINT) AS table_id, CAST(l_linenumber AS BIGINT) - 1 AS row_idx,
             l_orderkey, l_partkey, l_suppkey, l_extendedprice,
             CAST(1 + CAST(l_quantity AS INT) % 3 AS BIGINT) AS span,
             CAST(1 + l_partkey % 3 AS BIGINT) AS rowspan,
             CASE WHEN l_returnflag = 'R' THEN 'restart' WHEN l_returnflag = 'A' THEN 'continue' ELSE '' END AS vmerge,
             CASE WHEN l_partkey % 6 = 0 THEN '' WHEN l_partkey % 6 = 1 THEN CONCAT('Item ', l_partkey)
                  ELSE CAST(CAST(l_quantity AS INT) AS [[str]]) END AS text
      FROM lineitem) x"""

# grid columns with widths in table units; narrow ones are spacers
VIEWS["grid_cols"] = """
SELECT table_id, phys_idx, CASE WHEN (table_id + phys_idx) % 4 = 1 THEN CAST(58 AS BIGINT) ELSE CAST(1200 AS BIGINT) END AS width
FROM (SELECT table_id, MAX(w) AS w FROM (SELECT table_id, row_idx, SUM(span) AS w FROM grid GROUP BY table_id, row_idx) r
      GROUP BY table_id) t [[sequence phys_idx w]]"""

# number texts in every notation, one per line item
VIEWS["num_text"] = """
SELECT l_orderkey, k, a,
       CASE k WHEN 0 THEN [[fmt a]] WHEN 1 THEN CONCAT('(', [[fmt a]], ')') WHEN 2 THEN CONCAT('△', a)
              WHEN 3 THEN CONCAT('▲ ', [[fmt a]]) WHEN 4 THEN '-' WHEN 5 THEN '—' WHEN 6 THEN ''
              WHEN 7 THEN CONCAT(CHR(92), '  ', [[fmt a]]) WHEN 8 THEN CONCAT('₩', a) WHEN 9 THEN CONCAT('-', a)
              WHEN 10 THEN CONCAT(CAST(FLOOR(a / 100) AS BIGINT), '.', CAST(10 + a % 90 AS BIGINT))
              WHEN 11 THEN CONCAT(a % 100, '%') WHEN 12 THEN 'Net income' WHEN 13 THEN '   '
              WHEN 14 THEN CONCAT('abc', a) WHEN 15 THEN CONCAT('( ', [[fmt a]], ' )') WHEN 16 THEN '/'
              WHEN 17 THEN '–' WHEN 18 THEN CHR(92) WHEN 19 THEN CONCAT('  ', [[fmt a]], '  ')
              WHEN 20 THEN CONCAT('(', a % 1000, '.', CAST(10 + a % 90 AS BIGINT), ')')
              WHEN 21 THEN CONCAT('$', [[fmt a]]) ELSE '당기순이익' END AS text
FROM (SELECT l_orderkey, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS a,
             (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 23 AS k FROM lineitem) x"""

# statements: pairs with company % 5 = 0 are out by 2 (must fail), % 5 = 1 out by 1 (within tolerance)
VIEWS["stmt_rows"] = """
SELECT pair_id, stmt_type, CAST(r AS BIGINT) AS row_idx, col_idx,
       CASE WHEN stmt_type = 'BS' THEN CASE r WHEN 1 THEN 'Total assets' WHEN 2 THEN 'Total liabilities'
              WHEN 3 THEN 'Total equity' ELSE 'Total liabilities and equity' END
            WHEN stmt_type = 'IS' THEN CASE r WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Cost of sales' WHEN 3 THEN 'Gross profit'
              ELSE 'Profit for the year' END
            ELSE CASE r WHEN 1 THEN 'Net cash from operating activities' WHEN 2 THEN 'Net cash used in investing activities'
              WHEN 3 THEN 'Cash at beginning of year' ELSE 'Cash at end of year' END END AS label,
       CASE WHEN stmt_type = 'BS' THEN CASE r WHEN 1 THEN ta WHEN 2 THEN tl WHEN 3 THEN ta - tl + off
              ELSE CASE WHEN company % 3 = 0 THEN NULL ELSE ta + off END END
            WHEN stmt_type = 'IS' THEN CASE r WHEN 1 THEN ta WHEN 2 THEN CASE WHEN company % 2 = 0 THEN tl ELSE -tl END
              WHEN 3 THEN ta - tl - off ELSE ta - tl END
            ELSE CASE r WHEN 1 THEN ta WHEN 2 THEN -tl WHEN 3 THEN 5000 ELSE 5000 + ta - tl + off END END AS value
FROM (SELECT company * 10000 + yr + k AS pair_id, company, k AS col_idx, CAST(SUM(amt) AS BIGINT) AS ta,
             CAST(SUM(CASE WHEN note_no IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN amt ELSE 0 END) AS BIGINT) AS tl,
             CASE WHEN company % 5 = 0 THEN 2 WHEN company % 5 = 1 THEN 1 ELSE 0 END AS off
      FROM fact [[explode k 0 1]] GROUP BY company, yr, k) a
  [[explode r 1 2 3 4]] [[strings stmt_type BS IS CF]]"""

VIEWS["jobs"] = """
SELECT user_id AS job_id, MIN(ts) AS created_at, MAX(CASE WHEN event_type = 'purchase' THEN ts END) AS completed_at,
       CASE WHEN MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'failed'
            WHEN MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'completed'
            WHEN MAX(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) = 1 THEN 'processing' ELSE 'queued' END AS status
FROM events GROUP BY user_id"""

VIEWS["job_events"] = """
SELECT event_id, ts, user_id * 10 + CAST(FLOOR(value) AS BIGINT) % 5 AS job_id,
       CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'progress'
            ELSE 'log' END AS type,
       CASE WHEN event_type = 'signup' THEN CAST(FLOOR(value) AS BIGINT) % 101 END AS progress,
       CASE event_type WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN '구조 분석 시작' WHEN 1 THEN '현금흐름 처리'
                                             WHEN 2 THEN '주석 현금흐름' ELSE 'Year rolling' END
            WHEN 'click' THEN '매칭' ELSE event_type END AS message
FROM events"""

VIEWS["convs"] = """
SELECT conv_id, turn, role, text, CASE WHEN turn % 5 < 3 THEN 'read' ELSE 'write' END AS action
FROM conversations"""

# change set with addresses
VIEWS["changes"] = """
SELECT pair_id, note_no,
       CASE WHEN exp_cur IS NULL THEN 'delete_row' WHEN tpl_cur IS NULL THEN 'add_row' ELSE 'update_values' END AS type,
       CONCAT('table:', tpl_table, ':row:', tpl_row, ':col:2') AS target,
       tpl_table, tpl_row, CAST(exp_cur AS [[str]]) AS value
FROM row_pairs"""

# bodies of the templates: per table a title and the table, and one header
VIEWS["log_elements"] = """
SELECT pair_id, tpl_table * 2 + k AS pos, CASE WHEN k = 0 THEN 'table' ELSE 'paragraph' END AS kind, CASE WHEN k = 0 THEN '' ELSE CONCAT('Note ', CAST(tpl_table AS [[str]])) END AS text
FROM (SELECT DISTINCT pair_id, tpl_table FROM tpl_rows) t [[explode k -1 0]]
UNION ALL SELECT DISTINCT pair_id, CAST(0 AS BIGINT), 'header', CONCAT('December 31, ', CAST(pair_id % 10000 - 1 AS [[str]])) FROM tpl_rows"""

VIEWS["log_cells"] = """
SELECT pair_id, tpl_table * 2 AS pos, row_idx, phys_col AS col_idx, text FROM tpl_cells"""

# change log of every type, with numbers; some cells are written three times and some addresses are wrong
VIEWS["log_changes"] = """
SELECT pair_id, tpl_table * 100000 + tpl_row * 10 + k AS change_no, CASE WHEN k = 1 THEN type ELSE 'update_values' END AS type, tpl_table * 2 AS pos, CAST(NULL AS BIGINT) AS end_pos, tpl_row + CASE WHEN tpl_row % 13 = 7 AND k = 3 THEN 500 ELSE 0 END AS row_idx,
       CASE WHEN tpl_row % 7 = 3 THEN CAST(0 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS col_idx, CASE WHEN tpl_row % 2 = 0 THEN 'after' ELSE 'before' END AS side,
       CASE WHEN k = 1 THEN value WHEN k = 2 THEN '9' ELSE '10' END AS value, CAST(NULL AS [[str]]) AS old, CAST(NULL AS [[str]]) AS new
FROM changes [[explode k 1 2 3]] WHERE k = 1 OR tpl_row % 5 < 2
UNION ALL
SELECT pair_id, tpl_table * 100000 + 90000 + k,
       CASE WHEN k = 1 THEN 'update_text' WHEN k = 2 THEN 'delete_table' WHEN k = 3 THEN 'delete_note' WHEN k = 4 THEN 'add_table' WHEN k = 5 THEN 'add_note' WHEN k = 6 THEN 'add_column' WHEN k = 7 THEN 'move' ELSE 'update_text' END,
       tpl_table * 2 - CASE WHEN k IN (1, 3, 5) THEN 1 ELSE 0 END, CASE WHEN k IN (3, 5) THEN tpl_table * 2 + CASE WHEN (pair_id + tpl_table) % 22 = 0 THEN 2 WHEN (pair_id + tpl_table) % 33 = 0 THEN -5 ELSE 0 END END,
       CAST(NULL AS BIGINT), CASE WHEN k = 6 THEN CAST(2 AS BIGINT) END, CASE WHEN (pair_id + tpl_table) % 2 = 0 THEN 'after' ELSE 'before' END, CASE WHEN k IN (1, 8) THEN CONCAT('Restated ', CAST(tpl_table AS [[str]])) ELSE '77' END, CAST(NULL AS [[str]]), CAST(NULL AS [[str]])
FROM (SELECT DISTINCT pair_id, tpl_table FROM tpl_rows) t [[explode k 1 2 3 4 5 6 7 8]]
WHERE (k = 1 AND (pair_id + tpl_table) % 3 = 0) OR (k = 2 AND (pair_id + tpl_table) % 7 = 0) OR (k = 3 AND (pair_id + tpl_table) % 11 = 0) OR (k = 4 AND (pair_id + tpl_table) % 5 = 0) OR (k = 5 AND (pair_id + tpl_table) % 6 = 1)
   OR (k = 6 AND (pair_id + tpl_table) % 8 = 2) OR (k = 7 AND (pair_id + tpl_table) % 17 = 0) OR (k = 8 AND (pair_id + tpl_table) % 19 = 0)
UNION ALL
SELECT DISTINCT pair_id, CAST(99999999 AS BIGINT), 'restructure', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS [[str]]), CAST(NULL AS [[str]]), CAST(pair_id % 10000 - 1 AS [[str]]), CAST(pair_id % 10000 AS [[str]]) FROM tpl_rows"""

# The same rows for Spark in one pass over dealt rows: a table's first row brings its header rows along, so there is no union and nothing is dealt anew.
SPARK_VIEWS = {"src_cells": """
SELECT pair_id, note_no, r AS row_idx, c AS col_idx,
       CASE WHEN r = 0 THEN CASE WHEN c = 0 THEN CASE WHEN note_no IN ('MEDIUM', 'PROMO') THEN '(단위: 천원)' ELSE '(단위: 원)' END
                                 WHEN c = 1 THEN '당기말' ELSE '전기말' END
            WHEN c = 0 THEN label
            WHEN c = 2 THEN CASE WHEN pri_amt IS NULL THEN '' ELSE CAST(pri_amt AS [[str]]) END
            WHEN cur_amt IS NULL THEN '-'
            WHEN cur_amt % 5 = 0 THEN CONCAT('(', [[fmt cur_amt]], ')')
            WHEN cur_amt % 5 = 1 THEN CONCAT('△', cur_amt)
            WHEN cur_amt % 5 = 2 THEN CONCAT('₩', cur_amt)
            ELSE [[fmt cur_amt]] END AS text
FROM src_rows LATERAL VIEW explode(CASE WHEN row_idx = 1 THEN array(0L, 1L) ELSE array(row_idx) END) x_r AS r [[explode c 0 1 2]]""",
"tpl_cells": """
SELECT pair_id, tpl_table, r AS row_idx, CAST(c / 2 AS BIGINT) AS cell_idx, c AS phys_col,
       CASE WHEN c = 4 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS span,
       CASE WHEN r < 2 THEN CASE WHEN r = 0 AND c = 0 THEN '(in thousands of Korean won)'
                                 WHEN r = 1 AND c = 2 THEN CAST(pair_id % 10000 - 1 AS [[str]])
                                 WHEN r = 1 AND c = 4 THEN CAST(pair_id % 10000 - 2 AS [[str]]) ELSE '' END
            WHEN c = 0 THEN label
            WHEN c = 2 THEN CASE WHEN cur_amt IS NULL THEN '-' ELSE [[fmt cur_amt]] END
            ELSE CASE WHEN pri_amt IS NULL THEN '-' ELSE [[fmt pri_amt]] END END AS text
FROM tpl_rows LATERAL VIEW explode(CASE WHEN row_idx = 2 THEN array(0L, 1L, 2L) ELSE array(row_idx) END) x_r AS r [[explode c 0 2 4]]"""}


def _macro(kind: str, body: str, duck: bool) -> str:
    if kind == "str":
        return "VARCHAR" if duck else "STRING"
    if kind == "dealt":  # once for all: what is grouped, ranked or joined by pair and more stays where it is
        return "" if duck else f" /*+ REPARTITION({body}) */"
    if kind == "level":
        return body if duck else f"CASE WHEN lvl = 0 THEN {body} END AS {body}"
    if kind == "subtotals":  # grouping sets would hide that the rows are dealt already
        keys, last = body.split("; ")
        if duck:
            return f"GROUP BY GROUPING SETS (({keys}, {last}), ({keys}))"
        return f"LATERAL VIEW explode(array(0, 1)) x_lvl AS lvl GROUP BY {keys}, lvl, CASE WHEN lvl = 0 THEN {last} END"
    if kind == "fmt":
        return f"format('{{:,}}', {body})" if duck else f"format_number({body}, 0)"
    if kind == "explode":
        name, *vals = body.split()
        if duck:
            return f"CROSS JOIN (SELECT CAST(unnest([{', '.join(vals)}]) AS BIGINT) AS {name}) AS x_{name}"
        return f"LATERAL VIEW explode(array({', '.join(v + 'L' for v in vals)})) x_{name} AS {name}"
    if kind == "strings":
        name, *vals = body.split()
        quoted = ", ".join(f"'{v}'" for v in vals)
        if duck:
            return f"CROSS JOIN (SELECT unnest([{quoted}]) AS {name}) AS x_{name}"
        return f"LATERAL VIEW explode(array({quoted})) x_{name} AS {name}"
    if kind == "sequence":
        name, top = body.split()
        if duck:
            return f"CROSS JOIN LATERAL (SELECT CAST(unnest(range(0, CAST({top} AS BIGINT))) AS BIGINT) AS {name}) AS x_{name}"
        return f"LATERAL VIEW explode(sequence(0L, CAST({top} AS BIGINT) - 1)) x_{name} AS {name}"
    if kind == "re_extract":
        col, pattern, group = body.rsplit(" ", 2) if body.count(" ") == 2 else (
            body.split(" ", 1)[0], body.split(" ", 1)[1].rsplit(" ", 1)[0], body.rsplit(" ", 1)[1])
        return f"regexp_extract({col}, '{pattern}', {group})"
    if kind == "doclines":
        if duck:
            return ("(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, "
                    "unnest(string_split(text, chr(10))) AS line FROM documents) AS l")
        return "(SELECT doc_id, posexplode(split(text, '\\n')) AS (seq, line) FROM documents) l"
    if kind == "pagepieces":
        if duck:
            return ("(SELECT page_id, CAST(generate_subscripts(string_split(html, '<'), 1) - 1 AS BIGINT) AS seq, "
                    "unnest(string_split(html, '<')) AS piece FROM pages) AS l")
        return ("(SELECT page_id, CAST(seq AS BIGINT) AS seq, piece FROM "
                "(SELECT page_id, posexplode(split(html, '<')) AS (seq, piece) FROM pages) p) l")
    raise ValueError(kind)


def _render(sql: str, duck: bool) -> str:
    def sub(m: re.Match) -> str:
        kind, _, body = m.group(1).partition(" ")
        return _macro(kind, body, duck)

    return re.sub(r"\[\[(.+?)\]\](?!\])", sub, sql)


def _needed(names: list[str]) -> list[str]:
    """The views behind ``names``, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name in TABLES:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name].split("FROM", 1)[1]):
                visit(other)
        out.append(name)

    for n in names:
        visit(n)
    return out


def duckdb_ctes(names: list[str]) -> str:
    parts = [f"{n} AS MATERIALIZED ({_render(VIEWS[n], True)})" for n in _needed(names)]
    return "WITH " + ",\n".join(parts) if parts else ""


# Read by many views: ranked once and written, so that no task ranks the same rows several times over.
STORED = ("src_rows", "tpl_base")

LARGE = ("lineitem", "orders", "events", "documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that comes as a few unsplittable files is spread over the cores.

    With many files, as on a cluster, the scan is left as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in LARGE and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def open_views(spark: SparkSession, sf_dir: str, names: list[str]) -> list[DataFrame]:
    """The named tables and views as DataFrames over ``sf_dir``."""
    opened: dict[str, DataFrame] = {}
    needed = _needed(names)
    # the amounts are read off the line items; counted from the files' footers
    keep_dealt(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() if "fact" in needed else 0)

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = read_table(spark, sf_dir, name)
        return opened[name]

    for name in needed:
        sql = _render(SPARK_VIEWS.get(name, VIEWS[name]), False)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        for t in used:
            table(t).createOrReplaceTempView(t)
        for v, df in opened.items():
            if v in VIEWS and re.search(rf"\b{v}\b", sql):
                df.createOrReplaceTempView(v)
        opened[name] = spark.sql(sql)
        if name in STORED:
            opened[name] = stored(opened[name], "pair_id")
        elif name == "fact" and {"src_items", "tpl_items"} <= set(needed):
            opened[name] = stored(opened[name])
    return [table(n) for n in names]
