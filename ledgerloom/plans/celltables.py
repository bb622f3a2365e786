"""Queries: spans, column maps, headers, periods, amounts and reports over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nb
from ledgerloom.operators import cells as cl
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query
from ledgerloom.plans.scalars import DASH, LOOKS, TPLN, report_number, signature, source_amount

S = ["pair_id", "note_no"]
P = ["pair_id", "tpl_table"]
G = ["table_id"]
T = o.strip("text")
TPL_NUM = (f"({TPLN} IN ('-', '–', '—') OR ({TPLN} <> '' AND regexp_full_match(CASE WHEN {TPLN} LIKE '(%)' THEN {o.strip(f'substring({TPLN}, 2, length({TPLN}) - 2)')} ELSE {TPLN} END, "
           r"'-*([0-9]+\.?[0-9]*|\.[0-9]+)')))")


@query("a14_expand_spans", ["grid"])
def _a14(grid):
    return cl.expand_spans(grid, G)


PHYS = "(SELECT *, CAST(COALESCE(SUM(span) OVER (PARTITION BY table_id, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS phys_col FROM grid)"
CMAP = "(SELECT table_id, ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY phys_idx) - 1 AS logical_col, phys_idx FROM grid_cols WHERE NOT (width > 0 AND width < 200))"


@query("w05_physical_columns", ["grid"], f"SELECT table_id, row_idx, cell_idx, phys_col FROM {PHYS} q")
def _w05(grid):
    return cl.physical_columns(grid, G).select("table_id", "row_idx", "cell_idx", "phys_col")


@query("a16_column_map", ["grid_cols"], f"SELECT table_id, CAST(logical_col AS BIGINT) AS logical_col, phys_idx FROM {CMAP} q")
def _a16(cols):
    return cl.column_map(cols, G)


@query("a15_resolve_grid", ["grid", "grid_cols"], f"""
WITH c AS (SELECT p.*, m.logical_col, COUNT(*) OVER (PARTITION BY p.table_id, p.row_idx, p.cell_idx) AS cs FROM {PHYS} p JOIN {CMAP} m ON m.table_id = p.table_id AND m.phys_idx >= p.phys_col AND m.phys_idx < p.phys_col + p.span),
 i AS (SELECT *, SUM(CASE WHEN vmerge = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, logical_col ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS isl FROM c),
 n AS (SELECT *, COUNT(*) FILTER (vmerge = 'continue') OVER (PARTITION BY table_id, logical_col, isl) AS k FROM i)
SELECT table_id, row_idx, CAST(logical_col AS BIGINT) AS logical_col, CASE WHEN vmerge = 'continue' THEN '' ELSE text END AS text,
 CAST(CASE WHEN vmerge = 'continue' THEN 1 ELSE cs END AS BIGINT) AS colspan, CAST(CASE vmerge WHEN 'continue' THEN 0 WHEN 'restart' THEN 1 + k ELSE 1 END AS BIGINT) AS rowspan FROM n""")
def _a15(grid, cols):
    return cl.resolve_grid(grid, cols, G)


@query("c17_to_physical", ["grid", "grid_cols"], f"""
SELECT g.table_id, g.row_idx, g.cell_idx AS logical_col, COALESCE(m.phys_idx, g.cell_idx) AS phys_col FROM grid g LEFT JOIN {CMAP} m ON m.table_id = g.table_id AND m.logical_col = g.cell_idx""")
def _c17(grid, cols):
    v = grid.select("table_id", "row_idx", F.col("cell_idx").alias("logical_col"))
    return cl.to_physical(v, cl.column_map_or_cells(cols, grid, G), G)


@query("c18_nearest_cell", ["grid"], f"""
WITH p AS {PHYS}, w AS (SELECT DISTINCT table_id, row_idx, CAST(table_id % 9 AS BIGINT) AS target_col FROM grid),
 j AS (SELECT w.table_id, w.row_idx, w.target_col, p.phys_col, p.text, CASE WHEN target_col BETWEEN phys_col AND phys_col + span - 1 THEN 0 ELSE LEAST(ABS(phys_col - target_col), ABS(phys_col + span - 1 - target_col)) END AS distance
   FROM w JOIN p ON p.table_id = w.table_id AND p.row_idx = w.row_idx)
SELECT table_id, row_idx, target_col, phys_col, text, CAST(distance AS BIGINT) AS distance FROM (SELECT * FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY table_id, row_idx, target_col ORDER BY distance, phys_col) = 1) q WHERE distance <= 2""")
def _c18(grid):
    w = grid.select("table_id", "row_idx", (F.col("table_id") % 9).alias("target_col")).distinct()
    return cl.nearest_cell(w, cl.physical_columns(grid, G), G)


@query("a17_header_count", ["src_cells"], f"""
WITH r AS (SELECT pair_id, note_no, row_idx, COUNT(*) FILTER ({T} <> '' AND NOT {TPL_NUM}) AS w, COUNT(*) FILTER ({TPL_NUM}) AS n, bool_or({T} <> '') AS f FROM src_cells GROUP BY ALL),
 b AS (SELECT *, CASE WHEN NOT f THEN row_idx <> 1 ELSE w <= n AND n > 0 END AS brk FROM r)
SELECT pair_id, note_no, GREATEST(COALESCE(MIN(row_idx) FILTER (brk), COUNT(*)), 1) AS n_headers FROM b GROUP BY pair_id, note_no""")
def _a17(cells):
    return cl.header_count(cells, S)


@query("w06_header_rows", ["tpl_cells"], """
SELECT pair_id, tpl_table, CAST(CASE WHEN bool_or(row_idx = 1 AND regexp_matches(text, '[0-9]')) THEN 1 ELSE 2 END AS BIGINT) AS n_headers FROM tpl_cells WHERE row_idx < 2 GROUP BY ALL""")
def _w06(cells):
    return cl.header_rows_by_place(cells, P)


@query("s20_source_unit", ["src_cells"], """
SELECT pair_id, note_no, CASE WHEN bool_or(row_idx = 0 AND contains(text, '천원')) THEN 'thousand' ELSE 'won' END AS unit FROM src_cells GROUP BY pair_id, note_no""")
def _s20(cells):
    return cl.source_unit(cells, S)


@query("s21_template_unit", ["tpl_cells"], "SELECT pair_id, tpl_table, CASE WHEN bool_or(row_idx < 3 AND contains(lower(text), 'in millions')) THEN 'million' ELSE 'thousand' END AS unit FROM tpl_cells GROUP BY ALL")
def _s21(cells):
    return cl.template_unit(cells, P)


@query("s22_template_unit_text", ["tpl_cells"], "SELECT pair_id, tpl_table, COALESCE(MAX(text) FILTER (row_idx = 0 AND text LIKE '(in %'), '') AS unit_text FROM tpl_cells GROUP BY ALL")
def _s22(cells):
    return cl.template_unit_text(cells, P)


@query("w01_source_period_columns", ["src_cells"], """
SELECT pair_id, note_no, MAX(col_idx) FILTER (row_idx = 0 AND contains(text, '당기말')) AS cur_col, MAX(col_idx) FILTER (row_idx = 0 AND contains(text, '전기말')) AS pri_col FROM src_cells GROUP BY ALL""")
def _w01(cells):
    return cl.source_period_columns(cells, S)


AMOUNT_CELL = f"({T} NOT IN ('', '-', '–', '—', chr(92)) AND {LOOKS})"


@query("w02_rolled_period_columns", ["tpl_cells"], f"""
WITH h AS (SELECT pair_id, tpl_table, row_idx, cell_idx, CASE WHEN contains({T}, CAST(pair_id % 10000 - 1 AS VARCHAR)) OR contains({T}, CAST(pair_id % 10000 AS VARCHAR)) THEN 'current'
   WHEN contains({T}, CAST(pair_id % 10000 - 2 AS VARCHAR)) THEN 'prior' END AS period FROM tpl_cells WHERE row_idx < 2),
 f AS (SELECT DISTINCT pair_id, tpl_table, cell_idx FROM tpl_cells WHERE row_idx >= 2 AND {AMOUNT_CELL}),
 t AS (SELECT h.*, k.rank, h.cell_idx + k.step AS col FROM h CROSS JOIN (VALUES (0, 0), (1, 1), (2, -1)) k(rank, step) WHERE period IS NOT NULL)
SELECT t.pair_id, t.tpl_table, t.period, arg_min(t.col, LEAST(t.rank, 1) * 1000000 + t.row_idx * 1000 + t.cell_idx * 10 + t.rank) AS col
FROM t JOIN f ON f.pair_id = t.pair_id AND f.tpl_table = t.tpl_table AND f.cell_idx = t.col GROUP BY ALL""")
def _w02(cells):
    y = F.col("pair_id") % 10000
    years = cells.select("pair_id").distinct().select("pair_id", *[(y + k).cast("string").alias(n) for n, k in (
        ("old_current", -1), ("old_prior", -2), ("new_current", 0), ("new_prior", -1))])
    return cl.rolled_period_columns(cells, years, P)


START = "(SELECT pair_id, tpl_table, COALESCE(MIN(row_idx) FILTER (n >= 2 AND row_idx BETWEEN 2 AND 4), 2) AS s FROM (SELECT pair_id, tpl_table, row_idx, COUNT(*) FILTER (trim(text) <> '') AS n FROM tpl_cells GROUP BY ALL) q GROUP BY ALL)"


@query("w04_data_start_row", ["tpl_cells"], f"SELECT pair_id, tpl_table, s AS start_row FROM {START} q")
def _w04(cells):
    return cl.data_start_row(cells, P)


IS_CELL = f"({T} <> '' AND ({T} IN ('-', '–', '—', '/', chr(92)) OR regexp_full_match(replace(translate({T}, ',()- △▲' || chr(92), ''), '.', ''), '[0-9]*')))"
DATA_COLS = f"""(WITH b AS (SELECT c.pair_id, c.tpl_table, c.cell_idx, mode(c.phys_col) AS phys, AVG(CASE WHEN {IS_CELL} THEN 1.0 ELSE 0.0 END) AS share FROM tpl_cells c
   JOIN {START} st ON st.pair_id = c.pair_id AND st.tpl_table = c.tpl_table WHERE c.row_idx >= st.s AND c.cell_idx > 0 GROUP BY ALL),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tpl_table ORDER BY cell_idx) AS k FROM b WHERE share >= 0.7)
 SELECT pair_id, tpl_table, MAX(phys) FILTER (k = 1) AS cur_col, COALESCE(MAX(phys) FILTER (k = 2), -1) AS pri_col FROM k WHERE k <= 2 GROUP BY ALL)"""


@query("w03_data_columns", ["tpl_cells"], f"SELECT * FROM {DATA_COLS} q")
def _w03(cells):
    return cl.data_columns(cells, P)


@query("w07_numeric_columns", ["src_cells"], f"""
SELECT pair_id, note_no, col_idx, CAST(COUNT(*) AS BIGINT) AS n FROM src_cells WHERE ({source_amount('text')}) IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 3""")
def _w07(cells):
    return cl.numeric_columns(cells, S)


@query("a22_source_row_set", ["src_cells"], f"""
SELECT pair_id, note_no, row_idx, MAX(text) FILTER (col_idx = 0) AS label, MAX({o.whole('text')}) FILTER (col_idx = 1) AS cur_amt, MAX({o.whole('text')}) FILTER (col_idx = 2) AS pri_amt,
 CASE WHEN note_no IN ('MEDIUM', 'PROMO') THEN 'thousand' ELSE 'won' END AS unit, bool_or(regexp_matches(text, '합\\s*계|총\\s*계')) AS is_total, bool_or(regexp_matches(text, '소\\s*계')) AS is_subtotal
FROM src_cells WHERE row_idx > 0 GROUP BY pair_id, note_no, row_idx""")
def _a22(cells):
    return cl.source_row_set(cells, S)


@query("a23_template_row_set", ["tpl_cells"], f"""
WITH r AS (SELECT c.pair_id, c.tpl_table, c.row_idx, MAX({T}) FILTER (phys_col = 0) AS label, MAX({o.whole('text')}) FILTER (phys_col = d.cur_col) AS cur_amt, MAX({o.whole('text')}) FILTER (phys_col = d.pri_col) AS pri_amt, MAX(d.cur_col) AS cur_col, MAX(d.pri_col) AS pri_col
  FROM tpl_cells c JOIN {DATA_COLS} d ON d.pair_id = c.pair_id AND d.tpl_table = c.tpl_table JOIN {START} st ON st.pair_id = c.pair_id AND st.tpl_table = c.tpl_table WHERE c.row_idx >= st.s GROUP BY ALL)
SELECT *, 'thousand' AS unit FROM r WHERE label <> '' AND (cur_amt IS NOT NULL OR pri_amt IS NOT NULL)""")
def _a23(cells):
    return cl.template_row_set(cells, P)


@query("a24_table_values", ["tpl_cells"], f"SELECT pair_id, tpl_table, row_idx, phys_col, value FROM (SELECT *, {o.whole('text')} AS value FROM tpl_cells WHERE row_idx >= 2) q WHERE ABS(value) >= 10")
def _a24(cells):
    return cl.table_values(cells, P)


@query("a25_labelled_values", ["src_cells"], f"""
WITH c AS (SELECT *, {source_amount(T)} AS v FROM src_cells WHERE row_idx >= 1),
 l AS (SELECT pair_id, note_no, row_idx, arg_min(lower({T}), col_idx) AS label FROM c WHERE {T} <> '' AND v IS NULL GROUP BY ALL)
SELECT c.pair_id, c.note_no, c.row_idx, c.col_idx, l.label, CAST(c.v AS BIGINT) AS value FROM c JOIN l ON l.pair_id = c.pair_id AND l.note_no = c.note_no AND l.row_idx = c.row_idx WHERE c.v IS NOT NULL""")
def _a25(cells):
    return cl.labelled_values(cells, S)


@query("a26_row_numbers", ["src_cells"], f"""
SELECT pair_id, note_no, row_idx, COALESCE(string_agg({signature('text')}, '|' ORDER BY col_idx), '') AS numbers FROM src_cells GROUP BY ALL""")
def _a26(cells):
    return cl.row_signatures(cells, S).withColumn("numbers", F.array_join("numbers", "|"))


@query("a26_table_fingerprint", ["src_cells"], f"""
SELECT DISTINCT pair_id, note_no, value FROM (SELECT pair_id, note_no, row_idx, col_idx, CAST({report_number('text', 'value')} AS BIGINT) AS value FROM src_cells) q WHERE value <> 0""")
def _a26b(cells):
    return cl.table_fingerprint(cells, S, nb.parse_report_number_or_percent)


@query("w09_drop_repeats", ["row_pairs"], """
SELECT pair_id, note_no, src_row, CASE WHEN c = a AND a = b THEN CAST(a AS VARCHAR) WHEN a = b THEN CAST(a AS VARCHAR) || '|' || c WHEN b = c THEN a || '|' || b ELSE a || '|' || b || '|' || c END AS numbers
FROM (SELECT pair_id, note_no, src_row, COALESCE(exp_cur, 0) AS a, COALESCE(CASE WHEN src_row % 2 = 0 THEN exp_cur ELSE exp_pri END, 0) AS b, COALESCE(exp_pri, 0) AS c FROM row_pairs) q""")
def _w09(rows):
    nums = F.array(F.coalesce("exp_cur", F.lit(0)), F.coalesce(F.when(F.col("src_row") % 2 == 0, F.col("exp_cur")).otherwise(F.col("exp_pri")), F.lit(0)), F.coalesce("exp_pri", F.lit(0)))
    return rows.withColumn("nums", nums).select("pair_id", "note_no", "src_row", F.array_join(F.transform(cl.drop_repeats(F.col("nums")), lambda x: x.cast("string")), "|").alias("numbers"))


@query("e15_table_population", ["src_cells"], f"""
SELECT pair_id, note_no, CAST(a AS BIGINT) AS n_numbers, CAST(b AS BIGINT) AS n_dashes, CAST(f AS BIGINT) AS n_filled, CAST(c AS BIGINT) AS n_cells, CASE WHEN a = 0 THEN 'EMPTY' WHEN CAST(a AS DOUBLE) / c < 0.3 THEN 'SPARSE' ELSE 'POPULATED' END AS status
FROM (SELECT pair_id, note_no, COUNT(*) FILTER ({T} <> '' AND ({report_number('text', 'null')}) IS NOT NULL) AS a, COUNT(*) FILTER ({T} IN ('-', '–', '—')) AS b, COUNT(*) FILTER ({T} <> '') AS f, COUNT(*) AS c FROM src_cells WHERE row_idx > 0 GROUP BY ALL) q""")
def _e15(cells):
    return cl.population(cells, S)


@query("b03_table_as_text", ["src_cells"], """
WITH r AS (SELECT pair_id, note_no, row_idx, '| ' || string_agg(text, ' | ' ORDER BY col_idx) || ' |' AS line FROM src_cells GROUP BY ALL)
SELECT *, COUNT(*) OVER (PARTITION BY pair_id, note_no) AS n_rows FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY pair_id, note_no ORDER BY row_idx) <= 50""")
def _b03(cells):
    return cl.as_text_rows(cells, S, "col_idx")


@query("k01_row_cap", ["tpl_cells"], """
WITH r AS (SELECT pair_id, tpl_table, row_idx, '| ' || string_agg(text, ' | ' ORDER BY cell_idx) || ' |' AS line FROM tpl_cells GROUP BY ALL)
SELECT *, COUNT(*) OVER (PARTITION BY pair_id, tpl_table) AS n_rows FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY pair_id, tpl_table ORDER BY row_idx) <= 5""")
def _k01(cells):
    return cl.as_text_rows(cells, P, "cell_idx", limit=5)


@query("p03_empty_tables", ["src_notes", "src_cells"], """
SELECT n.pair_id, n.note_id AS note_no, CASE WHEN n.note_seq = 1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM src_notes n
WHERE NOT EXISTS (SELECT 1 FROM src_cells c WHERE c.pair_id = n.pair_id AND c.note_no = n.note_id AND c.row_idx >= 5)""")
def _p03(notes, cells):
    tables = notes.select("pair_id", F.col("note_id").alias("note_no"), (F.col("note_seq") == 1).alias("is_statement"))
    return cl.empty_tables(tables, cells, S, headers=5)


@query("p04_column_consistency", ["grid"], """
SELECT table_id, array_to_string(list_sort(list(DISTINCT w)), ',') AS widths FROM (SELECT table_id, row_idx, CAST(SUM(span) AS BIGINT) AS w FROM grid GROUP BY ALL) q GROUP BY table_id HAVING COUNT(DISTINCT w) > 1""")
def _p04(grid):
    return cl.uneven_tables(grid, G)


@query("p07_check_expected", ["tpl_cells", "row_pairs"], f"""
SELECT e.pair_id, e.tpl_table, e.tpl_row AS row_idx, CAST(2 AS BIGINT) AS phys_col, e.exp_pri AS expected, COALESCE(ABS(COALESCE({o.whole('c.text')}, 0) - e.exp_pri) <= 1, FALSE) AS ok
FROM row_pairs e LEFT JOIN tpl_cells c ON c.pair_id = e.pair_id AND c.tpl_table = e.tpl_table AND c.row_idx = e.tpl_row AND c.phys_col = 2""")
def _p07(cells, rows):
    e = rows.select("pair_id", "tpl_table", F.col("tpl_row").alias("row_idx"), F.lit(2).cast("bigint").alias("phys_col"), F.col("exp_pri").alias("expected"))
    return cl.check_expected(cells, e, P)


@query("a21_all_tables", ["src_cells", "stmt_rows"], """
SELECT pair_id, 'FS: ' || stmt_type AS label, CAST(COUNT(DISTINCT row_idx) AS BIGINT) AS n_rows FROM stmt_rows GROUP BY pair_id, stmt_type
UNION ALL SELECT pair_id, 'Note ' || note_no, COUNT(DISTINCT row_idx) FROM src_cells GROUP BY pair_id, note_no""")
def _a21(cells, stmts):
    n = F.count_distinct("row_idx").alias("n_rows")
    fs = stmts.groupBy("pair_id", F.concat(F.lit("FS: "), "stmt_type").alias("label")).agg(n)
    return fs.unionByName(cells.groupBy("pair_id", F.concat(F.lit("Note "), "note_no").alias("label")).agg(n))
