"""Queries: verification, repair, equations, review and quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.operators import cells as cl
from ledgerloom.operators import compare as cp
from ledgerloom.operators import quality as ql
from ledgerloom.operators import rows as rw
from ledgerloom.operators import tables as tb
from ledgerloom.operators import verify as vf
from ledgerloom.operators.sequence import row_position
from ledgerloom.plans import oracle as o
from ledgerloom.plans.matching import _pass_sql, cascade_ctes, sections_of
from ledgerloom.plans.registry import query
from ledgerloom.plans.rowwise import COMPARED, NUMBERS, SHARE, _amounts, number_sides
from ledgerloom.plans.scalars import norm_label

K = ["pair_id", "tpl_table"]


def _filled(f):
    return f.select("pair_id", "tpl_table", F.col("tpl_row").alias("row"), "is_total", "exp_cur", "exp_pri", "cur_text", "pri_text",
                    F.array("tpl_label", "cur_text", "pri_text").alias("row_texts"))


def _checked(src: str) -> str:
    """Oracle: verdict per cell of a filled table (pair_id, tpl_table, row, is_total, exp_*, *_text)."""
    v = o.whole
    return f"""(WITH l AS (SELECT pair_id, tpl_table, row, is_total, 'current' AS col_name, exp_cur AS e, trim(cur_text) AS t, {v('cur_text')} AS v, {v('cur_text')} AS c, {v('pri_text')} AS p FROM {src}
      UNION ALL SELECT pair_id, tpl_table, row, is_total, 'prior', exp_pri, trim(pri_text), {v('pri_text')}, {v('cur_text')}, {v('pri_text')} FROM {src}),
     j AS (SELECT *, e <> 0 AND (v IS NULL OR t IN ('', '-', '–', '—')) AS blank, COALESCE(ABS(c - e) <= 1, FALSE) OR COALESCE(ABS(p - e) <= 1, FALSE) AS els FROM l),
     d AS (SELECT *, CASE WHEN e IS NULL THEN 'correct' WHEN blank AND els THEN 'correct' WHEN blank THEN 'EMPTY_CELL' WHEN COALESCE(ABS(e - v) <= 1, FALSE) THEN 'correct'
       WHEN is_total THEN 'TOTAL_MISMATCH' ELSE 'NUMBER_MISMATCH' END AS verdict FROM j)
     SELECT pair_id, tpl_table, row, col_name, verdict, CASE verdict WHEN 'correct' THEN NULL WHEN 'NUMBER_MISMATCH' THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
       {o.fmt('e')} AS expected, CASE WHEN verdict = 'EMPTY_CELL' AND t = '' THEN '(nothing there)' ELSE t END AS found FROM d)"""


FILLED = "(SELECT pair_id, tpl_table, tpl_row AS row, is_total, exp_cur, exp_pri, cur_text, pri_text FROM filled)"


def _swaps(src: str) -> str:
    c, p = o.whole("cur_text"), o.whole("pri_text")
    return f"""(SELECT pair_id, tpl_table, row, el AS eligible, el AND sw AS swapped FROM (SELECT *, COALESCE(vc IS NOT NULL AND vp IS NOT NULL AND exp_cur <> 0 AND exp_pri <> 0 AND exp_cur <> exp_pri, FALSE) AS el,
      COALESCE(ABS(exp_cur - vp) <= 1 AND ABS(exp_pri - vc) <= 1 AND NOT (ABS(exp_cur - vc) <= 1 AND ABS(exp_pri - vp) <= 1), FALSE) AS sw FROM (SELECT *, {c} AS vc, {p} AS vp FROM {src} a) b) z)"""


def _shifts(src: str) -> str:
    return f"""(SELECT pair_id, tpl_table, CAST(COUNT(*) FILTER (swapped) AS BIGINT) AS n_swapped, CAST(COUNT(*) FILTER (eligible) AS BIGINT) AS n_eligible FROM {_swaps(src)} q GROUP BY ALL
      HAVING COUNT(*) FILTER (eligible) > 0 AND COUNT(*) FILTER (swapped) >= GREATEST(1, COUNT(*) FILTER (eligible) // 2))"""


def _errors(src: str) -> str:
    return f"""(SELECT pair_id, tpl_table, row, col_name, verdict AS error_type, severity, expected, found FROM {_checked(src)} q WHERE verdict <> 'correct'
      UNION ALL SELECT pair_id, tpl_table, CAST(-1 AS BIGINT), 'current/prior', 'COLUMN_SHIFT', 'CRITICAL', 'each column under its own heading', CAST(n_swapped AS VARCHAR) FROM {_shifts(src)} q)"""


REPAIRED = f"""(WITH f AS {FILLED}, sw AS {_swaps('f')}, sh AS {_shifts('f')},
   b AS (SELECT pair_id, tpl_table, row, bool_or(col_name = 'current') AS fc, bool_or(col_name = 'prior') AS fp FROM {_checked('f')} q WHERE verdict IN ('TOTAL_MISMATCH', 'EMPTY_CELL') GROUP BY ALL),
   j AS (SELECT f.*, sh.pair_id IS NOT NULL AND sw.swapped AND trim(cur_text) <> trim(pri_text) AS turn, sh.pair_id IS NULL AND COALESCE(b.fc, FALSE) AS oc, sh.pair_id IS NULL AND COALESCE(b.fp, FALSE) AS op
     FROM f JOIN sw USING (pair_id, tpl_table, row) LEFT JOIN sh ON sh.pair_id = f.pair_id AND sh.tpl_table = f.tpl_table LEFT JOIN b ON b.pair_id = f.pair_id AND b.tpl_table = f.tpl_table AND b.row = f.row)
   SELECT pair_id, tpl_table, row, is_total, exp_cur, exp_pri, CASE WHEN turn THEN pri_text WHEN oc THEN {o.fmt('exp_cur')} ELSE cur_text END AS cur_text,
     CASE WHEN turn THEN cur_text WHEN op THEN {o.fmt('exp_pri')} ELSE pri_text END AS pri_text, CAST(CASE WHEN turn THEN 2 ELSE CAST(oc AS INT) + CAST(op AS INT) END AS BIGINT) AS fixed FROM j)"""
MERGED = f"""(WITH a AS {_errors(FILLED)}, rp AS {REPAIRED}, z AS {_errors('rp')}
   SELECT a.*, z.pair_id IS NULL AS fixed FROM a LEFT JOIN z ON z.pair_id = a.pair_id AND z.tpl_table = a.tpl_table AND z.row = a.row AND z.col_name = a.col_name AND z.error_type = a.error_type
   UNION ALL SELECT z.*, FALSE FROM z WHERE NOT EXISTS (SELECT 1 FROM a WHERE z.pair_id = a.pair_id AND z.tpl_table = a.tpl_table AND z.row = a.row AND z.col_name = a.col_name AND z.error_type = a.error_type))"""


@query("v01_check_cells", ["filled"], f"SELECT * FROM {_checked(FILLED)} q")
def _v01(f):
    return vf.check_cells(_filled(f), K)


@query("v02_column_shift", ["filled"], f"SELECT * FROM {_shifts(FILLED)} q")
def _v02(f):
    return vf.column_shifts(vf.swapped_rows(_filled(f), K), K)


@query("v02_shifted_rows", ["filled"], f"""
SELECT s.pair_id, s.tpl_table, s.row FROM {_swaps(FILLED)} s JOIN {_shifts(FILLED)} h ON h.pair_id = s.pair_id AND h.tpl_table = s.tpl_table WHERE s.swapped""")
def _v02_rows(f):
    return vf.shifted_rows(vf.swapped_rows(_filled(f), K), K)


def _one_column(f):
    """Every fourth template table is taken to have no prior column, every fifth pair no current one in its first table."""
    return _filled(f).withColumns({"has_cur": ~((F.col("pair_id") % 5 == 0) & (F.col("tpl_table") % 100 == 1)), "has_pri": F.col("tpl_table") % 4 != 0})


ABSENT = "((col_name = 'prior' AND tpl_table % 4 = 0) OR (col_name = 'current' AND pair_id % 5 = 0 AND tpl_table % 100 = 1))"


@query("v01_absent_columns", ["filled"], f"SELECT * FROM {_checked(FILLED)} q WHERE NOT {ABSENT}")
def _v01_absent(f):
    return vf.check_cells(_one_column(f), K)


@query("v02_absent_columns", ["filled"], f"SELECT * FROM {_shifts(FILLED)} q WHERE tpl_table % 4 <> 0 AND NOT (pair_id % 5 = 0 AND tpl_table % 100 = 1)")
def _v02_absent(f):
    return vf.column_shifts(vf.swapped_rows(_one_column(f), K), K)


@query("v03_repair", ["filled"], f"SELECT pair_id, tpl_table, row, cur_text, pri_text, fixed FROM {REPAIRED} q")
def _v03(f):
    return vf.repair(_filled(f), K).select(*K, "row", "cur_text", "pri_text", "fixed")


def _merged(f):
    return vf.verify_and_repair(_filled(f), K)


@query("v04_reverify", ["filled"], f"SELECT * FROM {MERGED} q")
def _v04(f):
    return _merged(f)


@query("x05_unresolved", ["filled"], f"SELECT pair_id, tpl_table, row, col_name, error_type FROM {MERGED} q WHERE NOT fixed")
def _x05(f):
    return vf.unresolved(_merged(f)).select(*K, "row", "col_name", "error_type")


@query("b04_action_list", ["filled", "src_rows", "tpl_rows"], f"""
WITH {cascade_ctes()}
SELECT 'unresolved error' AS kind, pair_id, tpl_table AS at, row AS n, error_type AS what FROM {MERGED} e WHERE NOT fixed
UNION ALL SELECT 'unmatched table', pair_id, note_seq, CAST(COUNT(*) AS BIGINT), note_no FROM src_rows s WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.pair_id = s.pair_id AND m.note_seq = s.note_seq) GROUP BY pair_id, note_seq, note_no""")
def _b04_list(f, src, tpl):
    """What is left to do: errors that repair didn't settle, and source tables that no pass of the cascade placed."""
    errors = vf.unresolved(_merged(f)).select(F.lit("unresolved error").alias("kind"), "pair_id", F.col("tpl_table").alias("at"), F.col("row").alias("n"), F.col("error_type").alias("what"))
    tables = tb.unmatched_sources(src, tb.match_cascade(src, tpl, sections_of(tpl)))
    return errors.unionByName(tables.select(F.lit("unmatched table").alias("kind"), "pair_id", F.col("note_seq").alias("at"), F.col("n_rows").alias("n"), F.col("note_no").alias("what")))


@query("e09_verify_counters", ["filled"], f"""
SELECT pair_id, CAST(COUNT(*) AS BIGINT) AS cells_checked, CAST(COUNT(*) FILTER (verdict = 'correct') AS BIGINT) AS cells_correct, CAST(COUNT(*) FILTER (verdict <> 'correct') AS BIGINT) AS cells_wrong,
 CAST(COUNT(*) FILTER (severity = 'CRITICAL') AS BIGINT) AS critical FROM {_checked(FILLED)} q GROUP BY pair_id""")
def _e09(f):
    return vf.verify_counters(vf.check_cells(_filled(f), K), ["pair_id"])


# flagship: match tables by prior value, take the matched rows, check what was filled in against the matched source rows, sum up per pair
@query("flagship_match_and_verify", ["src_rows", "tpl_rows", "filled"], f"""
WITH m AS (SELECT * FROM {_pass_sql('src_rows', 'tpl_rows', 'prior', False, 1)} z),
 x AS (SELECT m.pair_id, m.note_seq, m.tpl_table, s.row_idx AS l, t.row_idx AS r, t.cur_amt AS v, m.pair_id * 10000000 + m.note_seq * 1000 + m.tpl_table AS g, t.row_idx AS o, 0.0 AS s,
   {o.convert('s.pri_amt', 's.unit', 't.unit')} AS e FROM m JOIN src_rows s ON s.pair_id = m.pair_id AND s.note_seq = m.note_seq JOIN tpl_rows t ON t.pair_id = m.pair_id AND t.tpl_table = m.tpl_table
   WHERE t.cur_amt <> 0 AND t.cur_amt = {o.convert('s.pri_amt', 's.unit', 't.unit')}),
 w AS (SELECT CAST(g // 10000000 AS BIGINT) AS pair_id, (g // 1000) % 10000 AS note_seq, g % 1000 AS tpl_table, l, r FROM {o.greedy('x')} z),
 fl AS (SELECT w.pair_id, w.tpl_table, w.r AS row, f.is_total, {o.convert('s.cur_amt', 's.unit', "'thousand'")} AS exp_cur, {o.convert('s.pri_amt', 's.unit', "'thousand'")} AS exp_pri, f.cur_text, f.pri_text
   FROM w JOIN src_rows s ON s.pair_id = w.pair_id AND s.note_seq = w.note_seq AND s.row_idx = w.l JOIN filled f ON f.pair_id = w.pair_id AND f.tpl_table = w.tpl_table AND f.tpl_row = w.r),
 ck AS (SELECT pair_id, tpl_table, row, COUNT(*) AS n, COUNT(*) FILTER (verdict <> 'correct') AS wrong, COUNT(*) FILTER (severity = 'CRITICAL') AS critical FROM {_checked('fl')} q GROUP BY ALL),
 c AS (SELECT pair_id, COUNT(*) FILTER (wrong = 0) AS confirmed, SUM(n) AS checked, SUM(wrong) AS wrong, SUM(critical) AS critical FROM ck GROUP BY 1),
 k AS (SELECT pair_id, COUNT(*) AS n FROM w GROUP BY 1),
 n AS (SELECT pair_id, COUNT(*) AS n_tables, SUM(CASE WHEN score >= 0.95 THEN 1 ELSE 0 END) AS perfect FROM m GROUP BY 1)
SELECT n.pair_id, CAST(n.n_tables AS BIGINT) AS tables_matched, CAST(n.perfect AS BIGINT) AS perfect_tables, CAST(COALESCE(k.n, 0) AS BIGINT) AS rows_matched, CAST(COALESCE(c.confirmed, 0) AS BIGINT) AS rows_confirmed,
 CAST(COALESCE(c.checked, 0) AS BIGINT) AS cells_checked, CAST(COALESCE(c.wrong, 0) AS BIGINT) AS cells_wrong, CAST(COALESCE(c.critical, 0) AS BIGINT) AS critical FROM n LEFT JOIN k ON k.pair_id = n.pair_id LEFT JOIN c ON c.pair_id = n.pair_id""")
def _flagship(src, tpl, filled):
    m = tb.stored(tb.match_by_prior_value(src, tpl), "pair_id")
    rows = tb.stored(tb.row_matches_by_value(src, tpl, m), "pair_id")
    amount = lambda c: nb.convert_unit(c, "unit", F.lit("thousand"))
    s = src.select(*tb.SRC, F.col("row_idx").alias("src_row"), amount("cur_amt").alias("exp_cur"), amount("pri_amt").alias("exp_pri"))
    written = filled.select(*K, "tpl_row", "is_total", "cur_text", "pri_text", F.array("tpl_label", "cur_text", "pri_text").alias("row_texts"))
    shown = rows.join(s, [*tb.SRC, "src_row"]).join(written, [*K, "tpl_row"]).withColumnRenamed("tpl_row", "row")
    by_row = vf.verify_counters(vf.check_cells(shown, K), [*K, "row"])
    total = lambda c: F.sum(c).alias(c)
    told = by_row.groupBy("pair_id").agg(F.count_if(F.col("cells_wrong") == 0).alias("rows_confirmed"), total("cells_checked"), total("cells_wrong"), total("critical"))
    n = m.groupBy("pair_id").agg(F.count("*").alias("tables_matched"), F.count_if(F.col("score") >= 0.95).alias("perfect_tables"))
    k = rows.groupBy("pair_id").agg(F.count("*").alias("rows_matched"))
    out = n.join(k, "pair_id", "left").join(told, "pair_id", "left").na.fill(0, ["rows_matched", "rows_confirmed", "cells_checked", "cells_wrong", "critical"])
    return out.select("pair_id", "tables_matched", "perfect_tables", "rows_matched", "rows_confirmed", "cells_checked", "cells_wrong", "critical")


# --- equations ---------------------------------------------------------------

SK = ["pair_id", "stmt_type"]


def _figure(name: str, strict: bool = False) -> str:
    words = vf.FIGURES[name]
    q = lambda w: w.replace("'", "''")
    hit = " OR ".join(f"contains(lb, '{q(w)}')" + ("" if strict else f" OR contains('{q(w)}', lb)") for w in words)
    return f"arg_min(value, row_idx) FILTER (value IS NOT NULL AND ({hit}))"


def _figs(stmt: str, strict: bool = False) -> str:
    cols = ", ".join(f"{_figure(n, strict)} AS {n}" for n in vf.FIGURES_OF[stmt])
    return f"(SELECT pair_id, stmt_type, col_idx, {cols} FROM (SELECT *, lower(label) AS lb FROM stmt_rows WHERE stmt_type = '{stmt}') q GROUP BY ALL HAVING COUNT(value) >= 3)"


def _bs(strict: bool) -> str:
    return f"""(SELECT pair_id, stmt_type, col_idx, CASE WHEN ABS(total_assets - found) <= 1 THEN 'INFO' ELSE 'CRITICAL' END AS severity, total_assets AS expected, found
      FROM (SELECT *, CASE WHEN total_le IS NOT NULL THEN total_le ELSE total_liabilities + total_equity END AS found FROM {_figs('BS', strict)} q) z WHERE total_assets IS NOT NULL AND found IS NOT NULL)"""


IS = f"""(SELECT pair_id, stmt_type, col_idx, CASE WHEN ABS(gross_profit - (revenue - ABS(cogs))) <= 1 THEN 'INFO' ELSE 'WARNING' END AS severity, revenue - ABS(cogs) AS expected, gross_profit AS found
  FROM {_figs('IS')} q WHERE revenue IS NOT NULL AND cogs IS NOT NULL AND gross_profit IS NOT NULL)"""
CFW = "beginning + COALESCE(operating, 0) + COALESCE(investing, 0) + COALESCE(financing, 0) + COALESCE(fx_effect, 0)"
CF = f"""(SELECT pair_id, stmt_type, col_idx, CASE WHEN ABS(ending - ({CFW})) <= 1 THEN 'INFO' ELSE 'WARNING' END AS severity, {CFW} AS expected, ending AS found
  FROM {_figs('CF')} q WHERE beginning IS NOT NULL AND ending IS NOT NULL AND COALESCE(operating, investing, financing, fx_effect) IS NOT NULL)"""


def _of(stmts, code):
    return stmts.where(F.col("stmt_type") == code)


@query("e10_balance_sheet", ["stmt_rows"], f"SELECT * FROM {_bs(False)} q")
def _e10(st):
    return vf.balance_sheet_check(_of(st, "BS"), SK)


@query("e10_balance_sheet_strict", ["stmt_rows"], f"SELECT * FROM {_bs(True)} q")
def _e10s(st):
    return vf.balance_sheet_check(_of(st, "BS"), SK, strict=True)


@query("e11_income", ["stmt_rows"], f"SELECT * FROM {IS} q")
def _e11(st):
    return vf.income_check(_of(st, "IS"), SK)


@query("e12_cash_flow", ["stmt_rows"], f"SELECT * FROM {CF} q")
def _e12(st):
    return vf.cash_flow_check(_of(st, "CF"), SK)


@query("v07_check_balances", ["stmt_rows"], f"SELECT * FROM {_bs(False)} q UNION ALL SELECT * FROM {IS} q UNION ALL SELECT * FROM {CF} q")
def _v07(st):
    return vf.check_balances(st, ["pair_id"])


@query("e13_find_figures", ["stmt_rows"], f"SELECT * FROM {_figs('CF')} q")
def _e13(st):
    return vf.figures(_of(st, "CF"), SK, vf.FIGURES_OF["CF"])


TIES = [("IS", "revenue", "BS", "total_assets"), ("CF", "operating", "IS", "revenue"), ("CF", "ending", "BS", "total_equity")]


@query("e14_statement_ties", ["stmt_rows"], """
WITH p AS (SELECT pair_id, col_idx, """ + ", ".join(
    f"arg_min(value, row_idx) FILTER (value IS NOT NULL AND stmt_type = '{s}' AND (" + " OR ".join("contains(lower(label), '" + w.replace("'", "''") + "')" for w in vf.FIGURES[f]) + f")) AS {s}_{f}"
    for s, f in sorted({(a, b) for a, b, _, _ in TIES} | {(c, d) for _, _, c, d in TIES})) + """ FROM stmt_rows GROUP BY ALL),
 t AS (""" + " UNION ALL ".join(f"SELECT pair_id, col_idx, '{a}.{b}={c}.{d}' AS tie, {a}_{b} AS lhs, {c}_{d} AS rhs FROM p" for a, b, c, d in TIES) + """)
SELECT *, ABS(lhs - rhs) <= 1 AS ok FROM t WHERE lhs IS NOT NULL AND rhs IS NOT NULL""")
def _e14(st):
    return vf.statement_ties(st.where("value is not null"), ["pair_id"], TIES)


# --- review ------------------------------------------------------------------

ROLL = """SELECT {k}, CASE WHEN GROUPING(severity) = 0 THEN severity END AS severity, CASE WHEN GROUPING(category) = 0 THEN category END AS category, CAST(COUNT(*) AS BIGINT) AS n,
 CASE WHEN GROUPING(severity) = 1 AND GROUPING(category) = 1 THEN CASE WHEN COUNT(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL_ERRORS' WHEN COUNT(*) FILTER (severity = 'WARNING') > 0 THEN 'NEEDS_REVISION' ELSE 'PASS' END END AS status
 FROM {t} q GROUP BY GROUPING SETS (({k}, severity), ({k}, category), ({k}))"""


@query("e01_findings_rollup", ["events"], ROLL.format(k="user_id", t="""(SELECT user_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS severity,
 CASE WHEN value < 10 THEN 'format' WHEN value < 40 THEN 'number' ELSE 'balance' END AS category FROM events)"""))
def _e01(events):
    sev = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    cat = F.when(F.col("value") < 10, "format").when(F.col("value") < 40, "number").otherwise("balance")
    return vf.roll_up(events.select("user_id", sev.alias("severity"), cat.alias("category")), "user_id")


NUMBER_FINDINGS = f"""(SELECT pair_id, severity, 'number' AS category FROM (SELECT pair_id, note_no, CASE WHEN COUNT(*) FILTER (verdict = 'mismatch') > 0 THEN 'CRITICAL' WHEN COUNT(*) FILTER (verdict = 'missing') > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM cmp GROUP BY ALL) q)"""


def _number_findings(sc, oc):
    keys = ["pair_id", "note_no"]
    f = cp.cell_findings(cp.compare_cells(_amounts(sc), _amounts(oc), keys), keys)
    return f.select("pair_id", "severity", F.lit("number").alias("category"))


@query("v05_validate_numbers", ["src_cells", "out_cells"], f"""WITH {COMPARED}
SELECT pair_id, severity, category, CAST(COUNT(*) AS BIGINT) AS n FROM {NUMBER_FINDINGS} q GROUP BY ALL""")
def _v05(sc, oc):
    return _number_findings(sc, oc).groupBy("pair_id", "severity", "category").agg(F.count("*").alias("n"))


@query("v06_review", ["src_cells", "out_cells", "stmt_rows", "src_notes", "tpl_notes"], f"""WITH {COMPARED},
 al AS (SELECT * FROM {NUMBER_FINDINGS} q UNION ALL SELECT pair_id, severity, 'balance' FROM ({_bs(False)} UNION ALL SELECT * FROM {IS} q UNION ALL SELECT * FROM {CF} q) b
   UNION ALL SELECT pair_id, 'WARNING', 'completeness' FROM src_notes s WHERE NOT EXISTS (SELECT 1 FROM tpl_notes t WHERE t.pair_id = s.pair_id AND t.note_id = s.note_id))
{ROLL.format(k='pair_id', t='al')}""".replace(f"FROM ({_bs(False)} UNION", f"FROM (SELECT * FROM {_bs(False)} q UNION"))
def _v06(sc, oc, st, sn, tn):
    b = vf.check_balances(st, ["pair_id"]).select("pair_id", "severity", F.lit("balance").alias("category"))
    c = sn.join(tn.select("pair_id", "note_id"), ["pair_id", "note_id"], "left_anti").select("pair_id", F.lit("WARNING").alias("severity"), F.lit("completeness").alias("category"))
    return vf.roll_up(_number_findings(sc, oc).unionByName(b).unionByName(c), "pair_id")


def _counted(n, number):
    return n.select("pair_id", "note_id", "note_seq", number.alias("number"), "title", (F.col("n_rows") % 3 + 1).alias("n_tables"), F.col("n_rows").alias("n_paras"))


@query("e03_completeness", ["src_notes", "tpl_notes"], """
WITH s AS (SELECT pair_id, CAST(note_seq AS VARCHAR) AS number, n_rows % 3 + 1 AS nt, n_rows AS np FROM src_notes),
 t AS (SELECT pair_id, number, arg_max(n_rows % 3 + 1, note_seq) AS nt, arg_max(n_rows, note_seq) AS np FROM tpl_notes GROUP BY pair_id, number)
SELECT s.pair_id, CAST(COUNT(*) AS BIGINT) AS expected_notes, CAST(COUNT(t.number) AS BIGINT) AS found_notes, CAST(SUM(s.nt) AS BIGINT) AS expected_tables, CAST(SUM(CASE WHEN t.number IS NULL THEN 0 ELSE LEAST(s.nt, t.nt) END) AS BIGINT) AS found_tables,
 CAST(SUM(s.np) AS BIGINT) AS expected_paras, CAST(SUM(CASE WHEN t.number IS NULL THEN 0 ELSE LEAST(s.np, t.np) END) AS BIGINT) AS found_paras, CAST(COUNT(*) FILTER (t.nt < s.nt) AS BIGINT) AS short_notes
FROM s LEFT JOIN t ON t.pair_id = s.pair_id AND t.number = s.number GROUP BY s.pair_id""")
def _e03(s, t):
    return vf.completeness(_counted(s, F.col("note_seq").cast("string")), _counted(t, F.col("number")))


@query("e03_missing_statements", ["stmt_rows"], """
SELECT DISTINCT pair_id, stmt_type, 'CRITICAL' AS severity FROM stmt_rows s WHERE NOT EXISTS (SELECT 1 FROM stmt_rows t WHERE t.pair_id = s.pair_id AND t.stmt_type = s.stmt_type AND t.value IS NULL)""")
def _e03m(st):
    return vf.missing_statements(st.select("pair_id", "stmt_type"), st.where("value is null").select("pair_id", "stmt_type"))


@query("v08_finish_gate", ["convs"], """
SELECT conv_id, turn, NOT (cr > 0 AND turn * 9 < 50) AND NOT (turn * 9 < 5) AS may_finish FROM (SELECT conv_id, turn, COUNT(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) % 2 AS cr FROM convs) q""")
def _v08(convs):
    open_errors = convs.groupBy("conv_id").agg((F.count_if(F.col("role") == "user") % 2).alias("cr"))
    return convs.join(open_errors, "conv_id").select("conv_id", "turn", vf.may_finish(F.col("turn") * 9, F.col("cr")).alias("may_finish"))


# --- quality -----------------------------------------------------------------

@query("e16_match_buckets", ["src_rows", "tpl_rows"], f"""WITH {SHARE}
SELECT pair_id, CASE WHEN score >= 0.95 THEN 'PERFECT' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'LOW' END AS bucket, CAST(COUNT(*) AS BIGINT) AS n FROM qm GROUP BY ALL""")
def _e16(src, tpl):
    m = cp.match_by_number_share(*number_sides(src, tpl))
    return m.groupBy("pair_id", ql.match_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


def _number_pairs(src, tpl):
    a, b, _ = number_sides(src, tpl)
    keys = ["pair_id", "id"]
    return a.where("value <> 0").select("pair_id", F.col("l").alias("id"), "value"), b.where("value <> 0").select("pair_id", F.col("r").alias("id"), "value"), keys


@query("x01_multiset_compare", ["src_rows", "tpl_rows"], f"""WITH {NUMBERS},
 a AS (SELECT pair_id, id, v, COUNT(*) AS n FROM nl WHERE v <> 0 GROUP BY ALL), b AS (SELECT pair_id, id, v, COUNT(*) AS n FROM nr WHERE v <> 0 GROUP BY ALL)
SELECT COALESCE(a.pair_id, b.pair_id) AS pair_id, COALESCE(a.id, b.id) AS id, CAST(SUM(LEAST(COALESCE(a.n, 0), COALESCE(b.n, 0))) AS BIGINT) AS matched, CAST(SUM(GREATEST(COALESCE(a.n, 0) - COALESCE(b.n, 0), 0)) AS BIGINT) AS missing,
 CAST(SUM(GREATEST(COALESCE(b.n, 0) - COALESCE(a.n, 0), 0)) AS BIGINT) AS extra FROM a FULL OUTER JOIN b ON a.pair_id = b.pair_id AND a.id = b.id AND a.v = b.v GROUP BY 1, 2""")
def _x01(src, tpl):
    return ql.multiset_compare(*_number_pairs(src, tpl))


SETS = f"""{NUMBERS}, sa AS (SELECT DISTINCT pair_id, id, v FROM nl WHERE v <> 0), sb AS (SELECT DISTINCT pair_id, id, v FROM nr WHERE v <> 0),
 sc AS (SELECT COALESCE(sa.pair_id, sb.pair_id) AS pair_id, COALESCE(sa.id, sb.id) AS id, COALESCE(sa.v, sb.v) AS value, CASE WHEN sa.v IS NULL THEN 'right' WHEN sb.v IS NULL THEN 'left' ELSE 'common' END AS side FROM sa FULL OUTER JOIN sb ON sa.pair_id = sb.pair_id AND sa.id = sb.id AND sa.v = sb.v)"""


@query("x02_set_compare_top5", ["src_rows", "tpl_rows"], f"WITH {SETS} SELECT pair_id, id, side, value, ROW_NUMBER() OVER (PARTITION BY pair_id, id, side ORDER BY ABS(value) DESC, value) AS k FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY pair_id, id, side ORDER BY ABS(value) DESC, value) <= 5")
def _x02(src, tpl):
    return ql.largest(ql.set_compare(*_number_pairs(src, tpl)), ["pair_id", "id", "side"])


@query("x03_value_overlap", ["src_rows", "tpl_rows"], f"""WITH {SETS}
SELECT pair_id, id, CAST(COUNT(*) AS BIGINT) AS n_shared FROM sc WHERE side = 'common' GROUP BY ALL HAVING COUNT(*) >= 2""")
def _x03(src, tpl):
    a, b, keys = _number_pairs(src, tpl)
    return ql.set_compare(a, b, keys).where("side = 'common'").groupBy(*keys).agg(F.count("*").alias("n_shared")).where("n_shared >= 2")


@query("x04_token_jaccard", ["documents", "benchmark"], """
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM documents), i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS k FROM benchmark),
 t AS (SELECT doc_id, item_id, a, b FROM d JOIN i ON i.k = doc_id % i.n)
SELECT doc_id, item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END AS sim FROM t""")
def _x04(docs, items):
    """Every document beside one benchmark item, all items in turn."""
    n = items.count()
    i = row_position(items.select(F.lit(1).alias("one"), "item_id", tx.word_tokens("text").alias("b")), ["one"], "item_id", "place").select("item_id", "b", (F.col("place") - 1).alias("k"))
    t = docs.select("doc_id", tx.word_tokens("text").alias("a"), (F.col("doc_id") % F.lit(max(n, 1))).alias("k")).join(i, "k")
    return t.select("doc_id", "item_id", tx.jaccard(F.col("a"), F.col("b")).alias("sim"))


@query("e18_error_patterns", ["filled"], f"""
SELECT pattern, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN exp_cur IS NULL OR f IS NULL THEN 'different' WHEN exp_cur = -f THEN 'sign' WHEN exp_pri = f THEN 'prior_in_current'
 WHEN exp_cur <> 0 AND f <> 0 AND ABS(CAST(f AS DOUBLE) / CAST(NULLIF(exp_cur, 0) AS DOUBLE)) IN (1000, 0.001, 1000000, 0.000001) THEN 'factor' ELSE 'different' END AS pattern
 FROM (SELECT exp_cur, exp_pri, {o.whole('cur_text')} AS f FROM filled) a WHERE COALESCE(exp_cur, 0) <> COALESCE(f, 0)) q GROUP BY pattern""")
def _e18(f):
    t = f.select("exp_cur", "exp_pri", nb.parse_whole("cur_text").cast("bigint").alias("f")).where(F.coalesce("exp_cur", F.lit(0)) != F.coalesce("f", F.lit(0)))
    return t.groupBy(ql.error_pattern(F.col("exp_cur"), F.col("exp_pri"), F.col("f")).alias("pattern")).agg(F.count("*").alias("n"))


NUMS = "list_filter([{a}, {b}, {a} - {b}{c}], lambda v: v IS NOT NULL)"


@query("e22_statement_compare", ["filled"], f"""
WITH r AS (SELECT pair_id, note_no, tpl_row, {NUMS.format(a='exp_cur', b='exp_pri', c='')} AS a, CASE WHEN tpl_row % 13 <> 4 THEN {NUMS.format(a=o.whole('cur_text'), b=o.whole('pri_text'), c=' + CASE WHEN tpl_row % 17 = 3 THEN 1 ELSE 0 END')} END AS b FROM filled),
 c AS (SELECT *, CASE WHEN b IS NULL THEN 'MISSING' WHEN (len(a) > 0 AND len(b) >= len(a) AND a = b[1:len(a)]) OR (len(a) = 0 AND len(b) = 0) THEN 'OK' ELSE 'WRONG' END AS st FROM r)
SELECT pair_id, note_no, CAST(COUNT(*) FILTER (st = 'OK') AS BIGINT) AS n_ok, CAST(COUNT(*) FILTER (st = 'WRONG') AS BIGINT) AS n_wrong, CAST(COUNT(*) FILTER (st = 'MISSING') AS BIGINT) AS n_missing, CAST(COUNT(*) AS BIGINT) AS n_rows,
 CAST(COUNT(*) FILTER (st = 'OK') AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS accuracy FROM c GROUP BY ALL""")
def _e22(f):
    keys = ["pair_id", "note_no"]
    a = f.select(*keys, F.col("tpl_row").alias("row_idx"), F.array_compact(F.array("exp_cur", "exp_pri", F.col("exp_cur") - F.col("exp_pri"))).alias("nums"))
    v = lambda c: nb.parse_whole(c).cast("bigint")
    off = F.when(F.col("tpl_row") % 17 == 3, 1).otherwise(0)
    b = f.where("tpl_row % 13 <> 4").select(*keys, F.col("tpl_row").alias("row_idx"), F.array_compact(F.array(v("cur_text"), v("pri_text"), v("cur_text") - v("pri_text") + off)).alias("nums"))
    return ql.accuracy(ql.compare_statement_rows(a, b, keys), keys)


@query("e17_total_rows", ["filled"], f"""
WITH v AS (SELECT pair_id, tpl_table, tpl_row, is_total, e, f FROM (SELECT pair_id, tpl_table, tpl_row, is_total, exp_cur AS e, {o.whole('cur_text')} AS f FROM filled UNION ALL SELECT pair_id, tpl_table, tpl_row, is_total, exp_pri, {o.whole('pri_text')} FROM filled) q),
 a AS (SELECT DISTINCT pair_id, tpl_table, tpl_row, e FROM v WHERE is_total AND e IS NOT NULL), b AS (SELECT DISTINCT pair_id, tpl_table, tpl_row, f FROM v WHERE is_total AND f IS NOT NULL), g AS (SELECT DISTINCT pair_id, tpl_table, f FROM v WHERE f IS NOT NULL),
 n AS (SELECT pair_id, tpl_table, tpl_row, COUNT(*) AS n FROM a GROUP BY ALL),
 s AS (SELECT n.pair_id, n.tpl_table, n.tpl_row, (SELECT COUNT(*) FROM a JOIN b ON b.pair_id = a.pair_id AND b.tpl_table = a.tpl_table AND b.f = a.e WHERE a.pair_id = n.pair_id AND a.tpl_table = n.tpl_table AND a.tpl_row = n.tpl_row) / CAST(n.n AS DOUBLE) AS o,
   (SELECT COUNT(*) FROM a JOIN g ON g.pair_id = a.pair_id AND g.tpl_table = a.tpl_table AND g.f = a.e WHERE a.pair_id = n.pair_id AND a.tpl_table = n.tpl_table AND a.tpl_row = n.tpl_row) / CAST(n.n AS DOUBLE) AS w FROM n)
SELECT pair_id, tpl_table, tpl_row AS row_idx, CASE WHEN CASE WHEN o >= 0.5 THEN o >= 0.9 ELSE w >= 0.5 END THEN 'correct' ELSE 'wrong' END AS status FROM s""")
def _e17(f):
    v = lambda c: nb.parse_whole(c).cast("bigint")
    row = F.col("tpl_row").alias("row_idx")
    want = f.where("is_total").select(*K, row, F.explode(F.array_compact(F.array("exp_cur", "exp_pri"))).alias("value"))
    got = f.select(*K, row, "is_total", F.explode(F.array_compact(F.array(v("cur_text"), v("pri_text")))).alias("value"))
    return ql.check_total_rows(want, got.where("is_total").drop("is_total"), got.select(*K, "value"), K)


@query("e04_section_magnitude", ["src_rows", "tpl_rows"], f"""
WITH a AS (SELECT pair_id, note_seq AS pos, COUNT(*) AS n FROM src_rows GROUP BY 1, 2), b AS (SELECT pair_id, tpl_table AS pos, COUNT(*) AS n FROM tpl_rows GROUP BY 1, 2),
 m AS (SELECT y.pair_id, y.pos, SUM(LEAST(x.c, y.c)) AS n FROM (SELECT pair_id, tpl_table AS pos, {norm_label('label')} AS lb, COUNT(*) AS c FROM tpl_rows GROUP BY 1, 2, 3) y
   JOIN (SELECT pair_id, note_seq AS pos, {norm_label('label')} AS lb, COUNT(*) AS c FROM src_rows GROUP BY 1, 2, 3) x ON x.pair_id = y.pair_id AND x.pos = y.pos AND x.lb = y.lb GROUP BY 1, 2),
 z AS (SELECT COALESCE(a.pair_id, b.pair_id) AS pair_id, a.n AS an, b.n AS bn, CASE WHEN a.n IS NULL OR b.n IS NULL OR COALESCE(m.n, 0) = 0 THEN 3 WHEN a.n > m.n OR b.n > m.n THEN 2 ELSE 1 END AS k FROM a FULL OUTER JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos LEFT JOIN m ON m.pair_id = COALESCE(a.pair_id, b.pair_id) AND m.pos = COALESCE(a.pos, b.pos))
SELECT pair_id, CAST(SUM(COALESCE(an, 0)) - SUM(COALESCE(bn, 0)) AS BIGINT) AS row_delta, CASE MAX(k) WHEN 3 THEN 'major' WHEN 2 THEN 'moderate' ELSE 'minor' END AS magnitude FROM z GROUP BY pair_id""")
def _e04(src, tpl):
    a = src.groupBy("pair_id", F.col("note_seq").alias("pos")).agg(F.count("*").alias("n_rows"))
    b = tpl.groupBy("pair_id", F.col("tpl_table").alias("pos")).agg(F.count("*").alias("n_rows"))
    s = src.select("pair_id", F.col("note_seq").alias("pos"), F.col("row_idx").alias("src_row"), F.col("label").alias("src_label"))
    t = tpl.select("pair_id", F.col("tpl_table").alias("pos"), F.col("row_idx").alias("tpl_row"), F.col("label").alias("tpl_label"))
    m = rw.match_exact_labels(s, t, ["pair_id", "pos"]).groupBy("pair_id", "pos").agg(F.count("*").alias("n_matched"))
    d = rw.zip_tables(a, b, ["pair_id"], m)
    delta = a.select("pair_id", "n_rows").unionByName(b.select("pair_id", (-F.col("n_rows")).alias("n_rows"))).groupBy("pair_id").agg(F.sum("n_rows").alias("row_delta"))
    return rw.section_magnitude(d, ["pair_id"]).join(delta, "pair_id")


@query("k03_note_order", ["src_notes"], """
SELECT pair_id, number, ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY COALESCE(TRY_CAST(number AS BIGINT), 999), number) AS place FROM src_notes""")
def _k03(notes):
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id").orderBy(F.coalesce(F.col("number").try_cast("bigint"), F.lit(999)), "number")
    return notes.select("pair_id", "number", F.row_number().over(w).cast("bigint").alias("place"))
