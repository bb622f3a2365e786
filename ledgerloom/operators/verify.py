"""Checks of filled tables, repair, accounting equations and the review report.

Filled rows: keys, row, is_total, exp_cur, exp_pri, cur_text, pri_text, row_texts
(all in the template's unit).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import DASHES, format_amount, parse_whole
from ledgerloom.functions.text import strip
from ledgerloom.session import stored

EMPTY_MARK = "(nothing there)"
SHIFT_EXPECTED = "each column under its own heading"


def _there(filled: DataFrame, column: str) -> Column:
    """Whether a table has a column; where nothing is said it has."""
    return F.coalesce(F.col(column), F.lit(True)) if column in filled.columns else F.lit(True)


def check_cells(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Each amount cell as ``correct`` or one of EMPTY_CELL, TOTAL_MISMATCH, NUMBER_MISMATCH.

    Cells of a table without such a column (``has_cur``, ``has_pri`` false, where given) are neither checked nor counted.
    """
    there = lambda c: _there(filled, c)
    long = filled.select(
        *keys, "row", "is_total", "row_texts", F.explode(F.array(
            F.struct(F.lit("current").alias("col_name"), F.col("exp_cur").alias("e"), F.col("cur_text").alias("raw"), there("has_cur").alias("there")),
            F.struct(F.lit("prior").alias("col_name"), F.col("exp_pri").alias("e"), F.col("pri_text").alias("raw"), there("has_pri").alias("there")))).alias("x")).where("x.there")
    c = long.select(*keys, "row", "is_total", "row_texts", "x.col_name", F.col("x.e").alias("e"), strip("x.raw").alias("t")).withColumn("v", parse_whole("t"))
    blank = (F.col("e") != 0) & (F.col("v").isNull() | F.col("t").isin("", *DASHES))
    # the rest of the row is parsed only behind a blank cell
    elsewhere = F.exists("row_texts", lambda o: F.coalesce(F.abs(parse_whole(o) - F.col("e")) <= 1, F.lit(False)))
    close = F.coalesce(F.abs(F.col("e") - F.col("v")) <= 1, F.lit(False))
    c = c.withColumn("verdict", F.when(F.col("e").isNull(), "correct").when(blank, F.when(elsewhere, "correct").otherwise("EMPTY_CELL")).when(close, "correct")
                     .when(F.col("is_total"), "TOTAL_MISMATCH").otherwise("NUMBER_MISMATCH"))
    verdict = F.col("verdict")
    severity = F.when(verdict == "correct", None).when(verdict == "NUMBER_MISMATCH", "WARNING").otherwise("CRITICAL")
    found = F.when((verdict == "EMPTY_CELL") & (F.col("t") == ""), EMPTY_MARK).otherwise(F.col("t"))
    return c.select(*keys, "row", "col_name", "verdict", severity.alias("severity"), format_amount("e").alias("expected"), found.alias("found"))


def swapped_rows(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: can a swap be told (``eligible``; not in a table without one of the columns), and are current and prior swapped."""
    f = filled.withColumns({"vc": parse_whole("cur_text"), "vp": parse_whole("pri_text")})
    e = F.col("vc").isNotNull() & F.col("vp").isNotNull() & (F.col("exp_cur") != 0) & (F.col("exp_pri") != 0) & (F.col("exp_cur") != F.col("exp_pri"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1
    swap = near("exp_cur", "vp") & near("exp_pri", "vc") & ~(near("exp_cur", "vc") & near("exp_pri", "vp"))
    e = F.coalesce(e, F.lit(False)) & _there(filled, "has_cur") & _there(filled, "has_pri")
    return f.select(*keys, "row", e.alias("eligible"), (e & F.coalesce(swap, F.lit(False))).alias("swapped"))


def column_shifts(swaps: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose columns are swapped in at least half of the telling rows."""
    g = swaps.groupBy(*keys).agg(F.count_if("swapped").alias("n_swapped"), F.count_if("eligible").alias("n_eligible"))
    return g.where((F.col("n_eligible") > 0) & (F.col("n_swapped") >= F.greatest(F.lit(1), F.floor(F.col("n_eligible") / 2))))


def shifted_rows(swaps: DataFrame, keys: list[str]) -> DataFrame:
    """The swapped rows of shifted tables."""
    return swaps.where("swapped").join(column_shifts(swaps, keys).select(*keys), keys, "left_semi").select(*keys, "row")


def find_errors(filled: DataFrame, keys: list[str]) -> DataFrame:
    """All errors; a shifted table is one error with row -1 and its swapped rows counted in ``found``."""
    cells = check_cells(filled, keys).where("verdict <> 'correct'").withColumnRenamed("verdict", "error_type")
    shifts = column_shifts(swapped_rows(filled, keys), keys).select(
        *keys, F.lit(-1).cast("bigint").alias("row"), F.lit("current/prior").alias("col_name"), F.lit("COLUMN_SHIFT").alias("error_type"),
        F.lit("CRITICAL").alias("severity"), F.lit(SHIFT_EXPECTED).alias("expected"), F.col("n_swapped").cast("string").alias("found"))
    return cells.unionByName(shifts)


def repair(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Filled rows after repair: swapped rows turned back, else totals and empty cells overwritten."""
    swaps = swapped_rows(filled, keys)
    shifted = column_shifts(swaps, keys).select(*keys, F.lit(True).alias("shifted"))
    bad = check_cells(filled, keys).where("verdict in ('TOTAL_MISMATCH', 'EMPTY_CELL')").groupBy(*keys, "row").agg(
        F.max(F.col("col_name") == "current").alias("fix_cur"), F.max(F.col("col_name") == "prior").alias("fix_pri"))
    f = filled.join(swaps.drop("eligible"), [*keys, "row"]).join(shifted, keys, "left").join(bad, [*keys, "row"], "left")
    turn = F.coalesce(F.col("shifted"), F.lit(False)) & F.col("swapped") & (strip("cur_text") != strip("pri_text"))
    over = lambda c: F.col("shifted").isNull() & F.coalesce(F.col(c), F.lit(False))
    cur = F.when(turn, F.col("pri_text")).when(over("fix_cur"), format_amount("exp_cur")).otherwise(F.col("cur_text"))
    pri = F.when(turn, F.col("cur_text")).when(over("fix_pri"), format_amount("exp_pri")).otherwise(F.col("pri_text"))
    out = f.withColumns({"_c": cur, "_p": pri, "fixed": F.when(turn, 2).otherwise(over("fix_cur").cast("int") + over("fix_pri").cast("int")).cast("bigint")})
    head = F.filter("row_texts", lambda x, i: i < F.size("row_texts") - 2)
    return out.withColumns({"cur_text": F.col("_c"), "pri_text": F.col("_p"), "row_texts": F.concat(head, F.array("_c", "_p"))}).select(*filled.columns, "fixed")


def merge_errors(first: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of the first check with ``fixed`` set where the second check no longer sees them, plus new ones."""
    at = [*keys, "row", "col_name", "error_type"]
    old = first.join(again.select(*at, F.lit(True).alias("still")), at, "left").withColumn("fixed", F.col("still").isNull()).drop("still")
    new = again.join(first.select(*at), at, "left_anti").withColumn("fixed", F.lit(False))
    return old.unionByName(new)


def verify_and_repair(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Check, repair once, check again: all errors with ``fixed``."""
    filled = stored(filled, *keys[:1])
    again = stored(repair(filled, keys).drop("fixed"), *keys[:1])
    first, second = (stored(find_errors(f, keys), *keys[:1]) for f in (filled, again))
    return merge_errors(first, second, keys)


def unresolved(errors: DataFrame) -> DataFrame:
    return errors.where("not fixed")


def verify_counters(checked: DataFrame, by: list[str]) -> DataFrame:
    """Checked, correct, wrong and critical cells."""
    ok = F.col("verdict") == "correct"
    return checked.groupBy(*by).agg(F.count("*").alias("cells_checked"), F.count_if(ok).alias("cells_correct"), F.count_if(~ok).alias("cells_wrong"),
                                    F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


# --- accounting equations ----------------------------------------------------

# Labels of the figures in an equation
FIGURES = {
    "total_assets": ["total assets", "assets, total"],
    "total_liabilities": ["total liabilities", "liabilities, total"],
    "total_equity": ["total equity", "total stockholders' equity", "total shareholders' equity", "equity, total"],
    "total_le": ["total liabilities and equity", "total liabilities and stockholders' equity", "total liabilities and shareholders' equity"],
    "revenue": ["revenue", "net revenue", "sales", "net sales", "operating revenue"],
    "cogs": ["cost of sales", "cost of goods sold", "cost of revenue", "cogs"],
    "gross_profit": ["gross profit", "gross margin"],
    "beginning": ["cash and cash equivalents at beginning", "beginning balance", "cash at beginning", "cash and cash equivalents, beginning"],
    "ending": ["cash and cash equivalents at end", "ending balance", "cash at end", "cash and cash equivalents, end"],
    "operating": ["net cash from operating activities", "net cash provided by operating activities", "cash flows from operating activities", "net cash used in operating activities"],
    "investing": ["net cash from investing activities", "net cash used in investing activities", "cash flows from investing activities"],
    "financing": ["net cash from financing activities", "net cash used in financing activities", "cash flows from financing activities"],
    "fx_effect": ["effect of exchange rate changes", "effect of foreign exchange", "foreign currency translation"],
}
FIGURES_OF = {
    "BS": ["total_assets", "total_liabilities", "total_equity", "total_le"],
    "IS": ["revenue", "cogs", "gross_profit"],
    "CF": ["beginning", "ending", "operating", "investing", "financing", "fx_effect"],
}


def names_figure(label: Column, figure: str, strict: bool = False) -> Column:
    """Label names the figure: keyword inside the label or (not strict) label inside the keyword."""
    hits = [label.contains(k) if strict else label.contains(k) | F.lit(k).contains(label) for k in FIGURES[figure]]
    return reduce(lambda a, b: a | b, hits)


def figures(values: DataFrame, keys: list[str], names: list[str], strict: bool = False, least: int = 3) -> DataFrame:
    """One row per column with the first value of each figure.  ``values``: keys, row_idx, col_idx, label, value."""
    low = F.lower(strip("label"))
    picks = [F.min_by("value", F.when(names_figure(low, n, strict) & F.col("value").isNotNull() & (low != ""), F.col("row_idx"))).alias(n) for n in names]
    return values.groupBy(*keys, "col_idx").agg(*picks, F.count("value").alias("n")).where(F.col("n") >= least).drop("n")


def balance_sheet_check(values: DataFrame, keys: list[str], strict: bool = False, tolerance: int = 1) -> DataFrame:
    """Assets against the liabilities-and-equity line, else against liabilities plus equity."""
    f = figures(values, keys, FIGURES_OF["BS"], strict)
    other = F.when(F.col("total_le").isNotNull(), F.col("total_le")).otherwise(F.col("total_liabilities") + F.col("total_equity"))
    f = f.withColumn("found", other).where("total_assets is not null and found is not null")
    ok = F.abs(F.col("total_assets") - F.col("found")) <= tolerance
    return f.select(*keys, "col_idx", F.when(ok, "INFO").otherwise("CRITICAL").alias("severity"), F.col("total_assets").alias("expected"), "found")


def income_check(values: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Gross profit against revenue less cost, whichever sign the cost has."""
    f = figures(values, keys, FIGURES_OF["IS"]).where("revenue is not null and cogs is not null and gross_profit is not null")
    want = F.col("revenue") - F.abs("cogs")
    return f.select(*keys, "col_idx", F.when(F.abs(F.col("gross_profit") - want) <= tolerance, "INFO").otherwise("WARNING").alias("severity"),
                    want.alias("expected"), F.col("gross_profit").alias("found"))


def cash_flow_check(values: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Ending cash against beginning cash plus the activities that are shown."""
    f = figures(values, keys, FIGURES_OF["CF"])
    parts = ["operating", "investing", "financing", "fx_effect"]
    f = f.where(F.col("beginning").isNotNull() & F.col("ending").isNotNull() & F.coalesce(*parts).isNotNull())
    want = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts], F.col("beginning"))
    return f.select(*keys, "col_idx", F.when(F.abs(F.col("ending") - want) <= tolerance, "INFO").otherwise("WARNING").alias("severity"),
                    want.alias("expected"), F.col("ending").alias("found"))


def check_balances(values: DataFrame, keys: list[str]) -> DataFrame:
    """All equations by statement type (``stmt_type``)."""
    checks = {"BS": balance_sheet_check, "IS": income_check, "CF": cash_flow_check}
    parts = [fn(values.where(F.col("stmt_type") == code), keys).withColumn("stmt_type", F.lit(code)) for code, fn in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def statement_ties(values: DataFrame, keys: list[str], ties: list[tuple[str, str, str, str]], tolerance: int = 1) -> DataFrame:
    """Figures that must agree across statements: (statement, figure, statement, figure)."""
    low = F.lower(strip("label"))
    picks = {(st, fig) for a, b, c, d in ties for st, fig in ((a, b), (c, d))}
    g = values.groupBy(*keys, "col_idx").agg(*[
        F.min_by("value", F.when((F.col("stmt_type") == st) & names_figure(low, fig, strict=True), F.col("row_idx"))).alias(f"{st}_{fig}") for st, fig in sorted(picks)])
    rows = F.array(*[F.struct(F.lit(f"{a}.{b}={c}.{d}").alias("tie"), F.col(f"{a}_{b}").alias("lhs"), F.col(f"{c}_{d}").alias("rhs")) for a, b, c, d in ties])
    x = g.select(*keys, "col_idx", F.explode(rows).alias("x")).select(*keys, "col_idx", "x.*")
    return x.where("lhs is not null and rhs is not null").withColumn("ok", F.abs(F.col("lhs") - F.col("rhs")) <= tolerance)


# --- report ------------------------------------------------------------------

def review_status(critical: Column, warning: Column) -> Column:
    return F.when(critical > 0, "CRITICAL_ERRORS").when(warning > 0, "NEEDS_REVISION").otherwise("PASS")


def roll_up(findings: DataFrame, key: str) -> DataFrame:
    """Counts per severity, per category and overall with the status, in one pass."""
    g = findings.groupingSets([[key, "severity"], [key, "category"], [key]], key, "severity", "category").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "WARNING").alias("w"),
        F.grouping_id().alias("gid"))
    total = F.col("gid") == 3
    return g.select(key, "severity", "category", "n", F.when(total, review_status(F.col("c"), F.col("w"))).alias("status"))


def completeness(src: DataFrame, out: DataFrame) -> DataFrame:
    """Notes, tables and paragraphs of the source found in the output, per pair.

    Notes: pair_id, note_id, note_seq, number, title, n_tables, n_paras.
    """
    from ledgerloom.functions.text import normalize_title

    s = src.withColumn("tk", normalize_title("title"))
    latest = lambda key: out.withColumn("tk", normalize_title("title")).where(F.col(key) != "").groupBy("pair_id", key).agg(
        F.max_by(F.struct("n_tables", "n_paras"), "note_seq").alias("hit"))
    j = s.join(latest("number").withColumnRenamed("hit", "h1"), ["pair_id", "number"], "left").join(
        latest("tk").withColumnRenamed("hit", "h2"), ["pair_id", "tk"], "left").withColumn("h", F.coalesce("h1", "h2"))
    got = F.col("h").isNotNull()
    return j.groupBy("pair_id").agg(
        F.count("*").alias("expected_notes"), F.count_if(got).alias("found_notes"), F.sum("n_tables").alias("expected_tables"),
        F.sum(F.when(got, F.least("n_tables", "h.n_tables")).otherwise(0)).alias("found_tables"), F.sum("n_paras").alias("expected_paras"),
        F.sum(F.when(got, F.least("n_paras", "h.n_paras")).otherwise(0)).alias("found_paras"),
        F.count_if(got & (F.col("h.n_tables") < F.col("n_tables"))).alias("short_notes"))


def missing_statements(src: DataFrame, out: DataFrame) -> DataFrame:
    """Statement types of the source without a counterpart: critical."""
    return src.join(out, ["pair_id", "stmt_type"], "left_anti").distinct().withColumn("severity", F.lit("CRITICAL"))


def may_finish(step: Column, critical_open: Column) -> Column:
    """A run may end once no critical error is open (or after fifty steps), never before step five."""
    return ~((critical_open > 0) & (step < 50)) & ~(step < 5)
