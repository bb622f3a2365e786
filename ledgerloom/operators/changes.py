"""Change sets: generating them, resolving their addresses, applying them to cells.

Cells:   pair_id, tpl_table, row_idx, phys_col, text [, vmerge]
Changes: pair_id, type, tpl_table, row_idx, phys_col, value, change_no
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import replace_in_turn
from ledgerloom.functions.numbers import format_amount, has_amount, is_amount_cell, is_label_cell, parse_whole
from ledgerloom.functions.text import strip
from ledgerloom.operators.rows import plausible_values
from ledgerloom.operators.sequence import carry_last, running_sum
from ledgerloom.session import stored

TABLE = ["pair_id", "tpl_table"]
CELL = [*TABLE, "row_idx", "phys_col"]


# --- filling -----------------------------------------------------------------

def fills_of(rows: DataFrame, cur_col: Column, pri_col: Column) -> DataFrame:
    """The amounts matched rows bring to their cells, formatted for the template.

    ``rows``: pair_id, tpl_table, tpl_row, exp_cur, exp_pri.
    """
    x = F.explode(F.array(F.struct(cur_col.alias("c"), F.col("exp_cur").alias("v")), F.struct(pri_col.alias("c"), F.col("exp_pri").alias("v"))))
    return rows.select(*TABLE, F.col("tpl_row").alias("row_idx"), x.alias("x")).where("x.c >= 0").select(
        *TABLE, "row_idx", F.col("x.c").cast("bigint").alias("phys_col"), format_amount("x.v").alias("value"))


def fill_cells(cells: DataFrame, fills: DataFrame) -> DataFrame:
    """Cells with their new text; labels are never overwritten.  ``status``: updated, skipped, missing."""
    j = fills.join(cells.select(*CELL, "text"), CELL, "left")
    status = F.when(F.col("text").isNull(), "missing").when(is_amount_cell("text"), "updated").otherwise("skipped")
    return j.select(*CELL, status.alias("status"), F.when(status == "updated", F.col("value")).otherwise(F.col("text")).alias("text"))


def fill_report(filled: DataFrame, matches: DataFrame) -> DataFrame:
    """Per matched table: score, rows matched by value, cells updated and skipped.

    ``matches``: pair_id, tpl_table, note_no, score, n_rows.
    """
    n = filled.groupBy(*TABLE).agg(F.count_if(F.col("status") == "updated").alias("cells_updated"), F.count_if(F.col("status") == "skipped").alias("cells_skipped"))
    return matches.join(n, TABLE, "left").na.fill(0, ["cells_updated", "cells_skipped"])


def leftover_rows_by_place(src: DataFrame, tpl: DataFrame, matched: DataFrame, keys: list[str], slack: float | None = None) -> DataFrame:
    """Rows without a value match in order, the k-th beside the k-th; a row with nothing beside it has NULL there, so none is lost.

    ``src``: keys, src_row; ``tpl``: keys, tpl_row; ``matched``: keys, src_row, tpl_row. With ``slack`` only tables whose left-over counts differ by no more than
    three, or that share of the source's, are paired.
    """
    def left(df, row):
        rest = df.select(*keys, row).join(matched.select(*keys, row), [*keys, row], "left_anti")
        return running_sum(rest, keys, row, F.lit(1), "k"), rest.groupBy(*keys).agg(F.count("*").alias("n" + row))

    (a, na), (b, nb) = left(src, "src_row"), left(tpl, "tpl_row")
    if slack is not None:
        ok = na.join(nb, keys).where(F.abs(F.col("nsrc_row") - F.col("ntpl_row")) <= F.greatest(F.lit(3.0), F.col("nsrc_row") * slack)).select(*keys)
        a, b = a.join(ok, keys, "left_semi"), b.join(ok, keys, "left_semi")
    return a.join(b, [*keys, "k"], "full_outer").drop("k")


def repair_totals(filled: DataFrame) -> DataFrame:
    """Total rows whose shown amount is off by more than one, overwritten.  Rows as in ``verify``."""
    t = filled.where("is_total").withColumns({"vc": parse_whole("cur_text"), "vp": parse_whole("pri_text")})
    off = lambda e, v: F.coalesce(F.abs(F.col(e) - F.col(v)) > 1, F.lit(False))
    t = t.withColumns({"oc": off("exp_cur", "vc"), "op": off("exp_pri", "vp")})
    return t.where("oc or op").select(
        *TABLE, "row", F.when(F.col("oc"), format_amount("exp_cur")).otherwise(F.col("cur_text")).alias("cur_text"),
        F.when(F.col("op"), format_amount("exp_pri")).otherwise(F.col("pri_text")).alias("pri_text"))


# --- generation --------------------------------------------------------------

def value_changes(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Cell updates of confidently matched rows: both texts are amounts and differ; nothing is added or deleted.

    ``pairs``: keys..., confidence, method, src_prior, tpl_current (amounts), src_text, tpl_text, target columns.
    """
    ok = (F.col("method") != "similar_label") | plausible_values(F.col("src_prior"), F.col("tpl_current"))
    return pairs.where((F.col("confidence") >= least) & ok & has_amount("src_text") & has_amount("tpl_text") & (strip("src_text") != strip("tpl_text"))).withColumn(
        "value", strip("src_text")).withColumn("type", F.lit("update_values"))


def year_roll_changes(source: DataFrame, template: DataFrame) -> DataFrame:
    """Header changes of documents that move on to another year.  Both: doc_id, period_current, period_prior."""
    j = source.select("doc_id", F.col("period_current").alias("nc"), F.col("period_prior").alias("np")).join(
        template.select("doc_id", F.col("period_current").alias("oc"), F.col("period_prior").alias("op")), "doc_id")
    j = j.where("nc <> '' and oc <> '' and nc <> oc")
    x = F.explode(F.array(F.struct(F.col("oc").alias("old_year"), F.col("nc").alias("new_year")), F.struct(F.col("op").alias("old_year"), F.col("np").alias("new_year"))))
    return j.select("doc_id", x.alias("x")).select("doc_id", F.lit("update_text").alias("type"), F.lit("header").alias("target"), "x.old_year", "x.new_year").where(
        "old_year is not null and new_year is not null and old_year <> ''")


# --- addresses ---------------------------------------------------------------

def resolve_notes(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Note-relative addresses as tables: the element-th table of the note, the last one when out of range.

    ``changes``: pair_id, change_id, note, element; ``tables``: pair_id, note, nth (from 0), tpl_table.
    Unresolvable changes keep a NULL table.
    """
    n = tables.groupBy("pair_id", "note").agg(F.max("nth").alias("top"))
    c = changes.join(n, ["pair_id", "note"], "left").withColumn("nth", F.greatest(F.least("element", "top"), F.lit(0)))
    return c.join(tables, ["pair_id", "note", "nth"], "left").drop("nth", "top")


def nearest_table(wanted: DataFrame, tables: DataFrame, reach: int = 3) -> DataFrame:
    """The table at a body position, else at +1, -1, +2, -2, +3, -3.  ``wanted``: pair_id, pos; ``tables``: pair_id, pos."""
    steps = [0] + [s for k in range(1, reach + 1) for s in (k, -k)]
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("step")) for i, s in enumerate(steps)]))
    w = wanted.select("pair_id", "pos").distinct().withColumn("t", tries).withColumn("at", F.col("pos") + F.col("t.step"))
    hit = w.join(tables.select("pair_id", F.col("pos").alias("at")).distinct(), ["pair_id", "at"])
    best = hit.groupBy("pair_id", "pos").agg(F.min_by("at", "t.rank").alias("tpl_table"))
    return wanted.join(best, ["pair_id", "pos"], "left")


def shift_positions(positions: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    """Body positions after deletions: ``pos - sum(min(count, pos - start))`` over earlier ranges.

    The shift is linear between range ends, so running sums of slope and
    intercept over the sorted ends replace a range join.
    ``positions``: keys, pos; ``deletions``: keys, start, count.
    """
    p = positions.select(*keys, "pos").distinct().select(*keys, "pos", F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(True).alias("q"))
    ends = deletions.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("a"), (-F.col("start")).alias("b")),
        F.struct((F.col("start") + F.col("count")).alias("pos"), F.lit(-1).alias("a"), (F.col("start") + F.col("count")).alias("b")))).alias("x"))
    e = ends.groupBy(*keys, "x.pos").agg(F.sum("x.a").cast("int").alias("a"), F.sum("x.b").alias("b")).withColumn("q", F.lit(False))
    u = p.unionByName(e)
    u = running_sum(u, keys, "pos", F.col("a"), "sa")
    u = running_sum(u, keys, "pos", F.col("b"), "sb")
    return u.where("q").select(*keys, "pos", (F.col("pos") - F.col("sa") * F.col("pos") - F.col("sb")).alias("new_pos"))


# --- application -------------------------------------------------------------

def update_cells(cells: DataFrame, updates: DataFrame, guard: bool = True) -> DataFrame:
    """All cells with updates applied; ``status`` ok or skipped (a label stands there), NULL if untouched."""
    # the latest change of a cell holds, whatever the order of the rows
    u = updates.groupBy(*CELL).agg(F.max_by("value", "change_no").alias("value"))
    j = cells.join(u, CELL, "left")
    asked = F.col("value").isNotNull()
    kept = is_label_cell("text") if guard else F.lit(False)
    return j.withColumn("status", F.when(asked & kept, "skipped").when(asked, "ok")).withColumn(
        "text", F.when(asked & ~kept, F.col("value")).otherwise(F.col("text"))).drop("value")


def delete_rows(cells: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cells without the deleted rows, later rows moved up; a merge origin hands over to its next continuation."""
    gone = deleted.select(*TABLE, "row_idx").distinct().withColumn("gone", F.lit(1))
    rows = cells.select(*TABLE, "row_idx").distinct().join(gone, [*TABLE, "row_idx"], "left")
    rows = running_sum(rows, TABLE, "row_idx", F.coalesce("gone", F.lit(0)), "before", inclusive=False)
    kept = rows.where("gone is null").select(*TABLE, "row_idx", (F.col("row_idx") - F.col("before")).alias("new_row"))
    if "vmerge" in cells.columns:
        cells = hand_over_merges(cells, deleted)
    return cells.join(kept, [*TABLE, "row_idx"]).withColumn("row_idx", F.col("new_row")).drop("new_row")


def hand_over_merges(cells: DataFrame, deleted: DataFrame) -> DataFrame:
    """``restart`` moves to the next continuation when only deleted rows lie between."""
    gone = deleted.select(*TABLE, "row_idx").distinct().withColumn("gone", F.lit(True))
    col = [*TABLE, "phys_col"]
    m = cells.join(gone, [*TABLE, "row_idx"], "left")
    m = carry_last(m, col, "row_idx", F.when(F.col("gone").isNull(), F.col("row_idx")), "stay", inclusive=False)
    m = carry_last(m, col, "row_idx", F.when(F.col("gone") & (F.col("vmerge") == "restart"), F.col("row_idx")), "origin", inclusive=False)
    promoted = (F.col("vmerge") == "continue") & (F.col("origin") > F.coalesce("stay", F.lit(-1)))
    return m.withColumn("vmerge", F.when(F.coalesce(promoted, F.lit(False)), "restart").otherwise(F.col("vmerge"))).drop("gone", "stay", "origin")


def delete_tables(cells: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cells without the deleted tables, later tables renumbered.  ``deleted``: pair_id, tpl_table."""
    ranges = deleted.distinct().select("pair_id", F.col("tpl_table").alias("start"), F.lit(1).cast("bigint").alias("count"))
    moved = shift_positions(cells.select("pair_id", F.col("tpl_table").alias("pos")), ranges, ["pair_id"])
    kept = cells.join(deleted.select(*TABLE), TABLE, "left_anti")
    return kept.join(moved.withColumnRenamed("pos", "tpl_table"), TABLE).withColumn("tpl_table", F.col("new_pos")).drop("new_pos")


def add_rows(cells: DataFrame, additions: DataFrame, spacers: DataFrame | None = None) -> DataFrame:
    """Cells with cloned rows put in; merges are not inherited, spacers stay as cloned.

    ``additions``: pair_id, tpl_table, ref_row, nth (1, 2, ... per place), place (before|after), values (map phys_col -> text).
    """
    n = additions.groupBy(*TABLE, F.col("ref_row").alias("row_idx")).agg(
        F.count_if(F.col("place") == "before").alias("nb"), F.count_if(F.col("place") == "after").alias("na"))
    rows = cells.select(*TABLE, "row_idx").distinct().join(n, [*TABLE, "row_idx"], "left").na.fill(0, ["nb", "na"])
    rows = running_sum(rows, TABLE, "row_idx", F.col("nb") + F.col("na"), "moved", inclusive=False)
    rows = stored(rows.select(*TABLE, "row_idx", "nb", (F.col("row_idx") + F.col("moved") + F.col("nb")).alias("new_row")), "pair_id")
    old = cells.join(rows.drop("nb"), [*TABLE, "row_idx"]).withColumn("row_idx", F.col("new_row")).drop("new_row").withColumn("added", F.lit(False))
    at = F.when(F.col("place") == "after", F.col("new_row") + F.col("nth")).otherwise(F.col("new_row") - F.col("nb") + F.col("nth") - 1)
    new = additions.withColumnRenamed("ref_row", "row_idx").join(rows, [*TABLE, "row_idx"]).join(cells, [*TABLE, "row_idx"])
    over = F.try_element_at("values", "phys_col")
    if spacers is not None:
        new = new.join(spacers.select(*TABLE, "phys_col", F.lit(True).alias("sp")), [*TABLE, "phys_col"], "left")
        over = F.when(F.col("sp").isNull(), over)
    new = new.withColumn("text", F.coalesce(over, "text")).withColumn("row_idx", at)
    if "vmerge" in cells.columns:
        new = new.withColumn("vmerge", F.lit(""))
    return old.unionByName(new.select(*cells.columns, F.lit(True).alias("added")))


def add_tables(cells: DataFrame, additions: DataFrame, headers: int = 2) -> DataFrame:
    """Cells with cloned tables put after their model; data rows take the given texts, or go blank.

    ``additions``: pair_id, ref_table, values (map row_idx -> map phys_col -> text).
    """
    n = additions.groupBy("pair_id", F.col("ref_table").alias("tpl_table")).agg(F.count("*").alias("n"))
    tables = cells.select(*TABLE).distinct().join(n, TABLE, "left").na.fill(0, ["n"])
    tables = running_sum(tables, ["pair_id"], "tpl_table", F.col("n"), "moved", inclusive=False)
    tables = tables.select(*TABLE, (F.col("tpl_table") + F.col("moved")).alias("new_table"))
    old = cells.join(tables, TABLE).withColumn("tpl_table", F.col("new_table")).drop("new_table").withColumn("added", F.lit(False))
    w = Window.partitionBy("pair_id", "tpl_table").orderBy("addition_id")
    a = additions.withColumnRenamed("ref_table", "tpl_table").withColumn("nth", F.row_number().over(w))
    new = a.join(tables, TABLE).join(cells, TABLE)
    text = F.coalesce(F.try_element_at(F.try_element_at("values", "row_idx"), "phys_col"), F.when((F.col("row_idx") < headers) | (F.col("phys_col") == 0), F.col("text")).otherwise(""))
    new = new.withColumn("text", text).withColumn("tpl_table", F.col("new_table") + F.col("nth"))
    return old.unionByName(new.select(*cells.columns, F.lit(True).alias("added")))


def apply_changes(cells: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletions, updates and additions in this order on original addresses, and the changes that failed.

    ``changes``: CELL columns, type (delete_row, update_values, add_row), value, change_no. Whole change sets, with every type, are in changelog.py.
    """
    cells, changes = stored(cells, "pair_id"), stored(changes, "pair_id")
    there = cells.select(*TABLE, "row_idx").distinct()
    failed = changes.join(there, [*TABLE, "row_idx"], "left_anti").withColumn("problem", F.lit("no such row"))
    doomed = changes.where("type = 'delete_row'").select(*TABLE, "row_idx").distinct()
    updates = changes.where("type = 'update_values'")
    updated = update_cells(cells.join(doomed, [*TABLE, "row_idx"], "left_anti"), updates).drop("status")
    lost = updates.join(doomed, [*TABLE, "row_idx"], "left_semi").withColumn("problem", F.lit("row was deleted"))
    adds = changes.where("type = 'add_row'").select(*TABLE, F.col("row_idx").alias("ref_row"), F.create_map("phys_col", "value").alias("values"), F.lit("after").alias("place"), "change_no").join(
        doomed.withColumnRenamed("row_idx", "ref_row"), [*TABLE, "ref_row"], "left_anti")
    adds = adds.withColumn("nth", F.row_number().over(Window.partitionBy(*TABLE, "ref_row").orderBy("change_no")))
    rows = there.join(doomed.withColumn("gone", F.lit(1)), [*TABLE, "row_idx"], "left")
    rows = running_sum(rows, TABLE, "row_idx", F.coalesce("gone", F.lit(0)), "before", inclusive=False).where("gone is null")
    rows = stored(rows.select(*TABLE, "row_idx", (F.col("row_idx") - F.col("before")).alias("new_row")), "pair_id")
    moved = stored(updated.join(rows, [*TABLE, "row_idx"]).withColumn("row_idx", F.col("new_row")).drop("new_row"), "pair_id")
    adds = adds.join(rows.withColumnRenamed("row_idx", "ref_row"), [*TABLE, "ref_row"]).withColumn("ref_row", F.col("new_row")).drop("new_row")
    return add_rows(moved, stored(adds, "pair_id")), failed.unionByName(lost)


# --- text --------------------------------------------------------------------

def redistribute(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A paragraph's new text over its runs: old lengths kept, the last run takes the rest.

    ``runs``: keys (one paragraph), run_idx, text, new_text.
    """
    w = Window.partitionBy(*keys).orderBy("run_idx")
    start = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int") + 1
    last = F.lead("run_idx").over(w).isNull()
    part = F.when(last, F.substring("new_text", start, F.lit(2_000_000_000))).otherwise(F.substring("new_text", start, F.length("text")))
    return runs.select(*keys, "run_idx", part.alias("text"))


def roll_years(texts: DataFrame, header_rows: int = 3) -> DataFrame:
    """Year rolling by zone: headers, footers and the first table rows take all pairs, prose only safe ones.

    ``texts``: doc_id, zone (header|footer|table|paragraph), row_idx, text, pairs, prose_pairs.
    """
    everywhere = F.col("zone").isin("header", "footer") | ((F.col("zone") == "table") & (F.col("row_idx") < header_rows))
    new = F.when(everywhere, replace_in_turn("text", F.col("pairs"))).when(F.col("zone") == "paragraph", replace_in_turn("text", F.col("prose_pairs"))).otherwise(F.col("text"))
    return texts.withColumn("new_text", new).withColumn("changed", F.col("new_text") != F.col("text"))


def replace_years_in_order(text: str, years: list[tuple[Column, Column]]) -> Column:
    """One replacement after the other, latest year first: the older way, which can cascade."""
    out = F.col(text)
    for old, new in years:
        out = F.replace(out, old, new)
    return out
