"""Tables as cell rows: spans, column maps, headers, periods and amounts.

Source cells:   keys, row_idx, col_idx, text
Template cells: keys, row_idx, cell_idx, phys_col, span, text
``keys`` name one table (document and table).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.operators.sequence import row_position, running_max, running_sum
from ledgerloom.session import durable, once, stored

# Fixed values
SPACER_WIDTH = 200
CURRENT_MARKS = ["당기", "당기말", "당분기", "당분기말"]
PRIOR_MARKS = ["전기", "전기말", "전분기", "전분기말"]


def _let(value: Column, body) -> Column:
    """Bind a value inside an array expression so it is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# --- spans -------------------------------------------------------------------

CARRY = "array<struct<c:bigint,left:bigint,t:string>>"
CELLS = "array<struct<c:bigint,t:string>>"


def _free_from(carry: Column, col: Column) -> Column:
    """First column at or after ``col`` that no open row span occupies."""
    return F.array_min(F.filter(F.sequence(col, col + F.size(carry)), lambda c: ~F.exists(carry, lambda x: x["c"] == c)))


def _emit(state: Column, upto: Column) -> tuple[Column, Column]:
    """Cells carried down between the state's column and ``upto``, and the spans left afterwards."""
    inside = lambda x: (x["c"] >= state["col"]) & (x["c"] < upto)
    sent = F.array_sort(F.transform(F.filter(state["carry"], inside), lambda x: F.struct(x["c"].alias("c"), x["t"].alias("t"))))
    left = F.transform(
        F.filter(state["carry"], lambda x: ~inside(x) | (x["left"] > 1)),
        lambda x: F.struct(x["c"].alias("c"), F.when(inside(x), x["left"] - 1).otherwise(x["left"]).alias("left"), x["t"].alias("t")))
    return sent, left


def _place(state: Column, cell: Column) -> Column:
    def at(free: Column) -> Column:
        sent, left = _emit(state, free)
        cols = F.sequence(free, free + cell["span"] - 1)
        own = F.transform(cols, lambda c: F.struct(c.alias("c"), F.when(c == free, cell["text"]).otherwise("").alias("t")))
        kept = F.filter(left, lambda x: ~F.array_contains(cols, x["c"]) | (cell["rowspan"] <= 1))
        opened = F.when(cell["rowspan"] > 1, F.transform(cols, lambda c: F.struct(c.alias("c"), (cell["rowspan"] - 1).alias("left"), cell["text"].alias("t")))).otherwise(
            F.array().cast(CARRY))
        return F.struct((free + cell["span"]).alias("col"), F.concat(state["out"], sent, own).alias("out"), F.concat(kept, opened).alias("carry"))

    return _let(_free_from(state["carry"], state["col"]), at)


def _expand_row(carry: Column, cells: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("col"), F.array().cast(CELLS).alias("out"), carry.alias("carry"))
    placed = F.aggregate(cells, start, _place)

    def close(s: Column) -> Column:
        sent, left = _emit(s, _free_from(s["carry"], s["col"]))
        return F.struct(F.concat(s["out"], sent).alias("out"), left.alias("carry"))

    return _let(placed, close)


def _fold_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of each group in order, spans opened by one row closed by the next ones."""
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<row_idx:bigint,out:" + CELLS + ">>").alias("done"), F.array().cast(CARRY).alias("carry"))
    folded = F.aggregate("rows", start, lambda acc, row: _let(
        _expand_row(acc["carry"], row["cells"]),
        lambda e: F.struct(F.concat(acc["done"], F.array(F.struct(row["row_idx"].alias("row_idx"), e["out"].alias("out")))).alias("done"), e["carry"].alias("carry"))))
    return lists.select(*group, folded.alias("f")).select(*group, F.col("f.done").alias("done"), (F.size("f.carry") > 0).alias("open"))


def expand_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column spans repeated as blanks, row spans copied down: one row per grid cell.

    ``cells``: keys, row_idx, cell_idx, span, rowspan, text.  A table is cut
    where no row span reaches across, so a long table is folded in many runs.
    A ragged table may leave a span open at a cut; only such tables are folded
    again in one piece.
    """
    rows = cells.groupBy(*keys, "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "span", "rowspan", "text"))), lambda x: F.struct(
            x["span"].alias("span"), x["rowspan"].alias("rowspan"), x["text"].alias("text"))).alias("cells"),
        F.max("rowspan").alias("reach"))
    rows = row_position(rows, keys, "row_idx", "pos")
    rows = running_max(rows, keys, "row_idx", F.col("pos") + F.col("reach") - 1, "covered")
    rows = running_sum(rows, keys, "row_idx", F.when(F.coalesce("covered", F.lit(0)) < F.col("pos"), 1).otherwise(0), "run")
    rows = durable(rows.select(*keys, "run", "row_idx", "cells"))
    runs = durable(_fold_rows(rows, [*keys, "run"]))
    last = runs.groupBy(*keys).agg(F.max("run").alias("last"))
    ragged = runs.where("open").join(last, keys).where("run < last").select(*keys).distinct()
    again = _fold_rows(rows.join(ragged, keys, "left_semi"), keys)
    done = runs.join(ragged, keys, "left_anti").select(*keys, "done").unionByName(again.select(*keys, "done"))
    out = done.select(*keys, F.explode("done").alias("r")).select(*keys, F.col("r.row_idx").alias("row_idx"), F.posexplode("r.out").alias("n", "x"))
    return out.select(*keys, "row_idx", F.col("n").cast("bigint").alias("col_idx"), F.col("x.t").alias("text"))


def physical_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``phys_col``, the running sum of spans within a row."""
    w = Window.partitionBy(*keys, "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("phys_col", F.coalesce(F.sum("span").over(w), F.lit(0)).cast("bigint"))


def column_map(columns: DataFrame, keys: list[str], spacer_width: int = SPACER_WIDTH) -> DataFrame:
    """Logical to physical columns; narrow ones are spacers and take no logical column."""
    real = columns.where(~((F.col("width") > 0) & (F.col("width") < spacer_width)))
    return row_position(real, keys, "phys_idx", "n").select(*keys, (F.col("n") - 1).alias("logical_col"), "phys_idx")


def column_map_or_cells(columns: DataFrame, cells: DataFrame, keys: list[str], spacer_width: int = SPACER_WIDTH) -> DataFrame:
    """As :func:`column_map`; a table without column widths takes the cells of its first row."""
    bare = cells.where("row_idx = 0").join(columns.select(*keys).distinct(), keys, "left_anti")
    return column_map(columns, keys, spacer_width).unionByName(
        bare.select(*keys, F.col("cell_idx").alias("logical_col"), F.col("cell_idx").alias("phys_idx")))


def to_physical(values: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Logical column addresses as physical ones; unknown columns stay as they are."""
    return values.join(mapping, [*keys, "logical_col"], "left").withColumn("phys_col", F.coalesce("phys_idx", "logical_col")).drop("phys_idx")


def resolve_grid(cells: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Template cells on logical columns with their spans; merged continuations get row span 0.

    ``cells``: keys, row_idx, cell_idx, span, vmerge, text; ``columns``: keys, phys_idx, width.
    """
    placed = physical_columns(cells, keys).withColumn("phys_idx", F.explode(F.expr("sequence(phys_col, phys_col + span - 1)")))
    on = placed.join(column_map(columns, keys), [*keys, "phys_idx"])
    one = on.groupBy(*keys, "row_idx", "cell_idx").agg(F.count("*").alias("colspan"))
    on = on.join(one, [*keys, "row_idx", "cell_idx"]).select(*keys, "logical_col", "row_idx", "text", "vmerge", "colspan")
    col = [*keys, "logical_col"]
    s = running_sum(on, col, "row_idx", F.when(F.col("vmerge") == "continue", 0).otherwise(1), "island")
    size = s.groupBy(*col, "island").agg(F.count_if(F.col("vmerge") == "continue").alias("merged"))
    s = s.join(size, [*col, "island"])
    cont = F.col("vmerge") == "continue"
    return s.select(
        *keys, "row_idx", "logical_col", F.when(cont, "").otherwise(F.col("text")).alias("text"),
        F.when(cont, 1).otherwise(F.col("colspan")).cast("bigint").alias("colspan"),
        F.when(cont, 0).when(F.col("vmerge") == "restart", 1 + F.col("merged")).otherwise(1).cast("bigint").alias("rowspan"))


def nearest_cell(wanted: DataFrame, cells: DataFrame, keys: list[str], max_distance: int | None = 2) -> DataFrame:
    """The cell spanning a physical column, else the nearest one within ``max_distance``.

    ``wanted``: keys, row_idx, target_col; ``cells`` with phys_col and span.
    """
    j = wanted.join(cells, [*keys, "row_idx"])
    end = F.col("phys_col") + F.col("span") - 1
    inside = (F.col("phys_col") <= F.col("target_col")) & (F.col("target_col") <= end)
    dist = F.when(inside, F.lit(0)).otherwise(F.least(F.abs(F.col("phys_col") - F.col("target_col")), F.abs(end - F.col("target_col"))))
    best = j.groupBy(*keys, "row_idx", "target_col").agg(
        F.min(F.struct((~inside).alias("out"), dist.alias("d"), F.col("phys_col"), F.col("text"))).alias("m"))
    if max_distance is not None:
        best = best.where(F.col("m.d") <= max_distance)
    return best.select(*keys, "row_idx", "target_col", F.col("m.phys_col").alias("phys_col"), F.col("m.text").alias("text"), F.col("m.d").cast("bigint").alias("distance"))


# --- headers -----------------------------------------------------------------

def header_count(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Leading rows with more text than numbers; an empty second row is stepped over; at least one."""
    t = tx.strip("text")
    rows = cells.groupBy(*keys, "row_idx").agg(
        F.count_if((t != "") & ~nb.is_template_number("text")).alias("words"), F.count_if(nb.is_template_number("text")).alias("nums"),
        F.max(t != "").alias("filled"))
    stop = F.when(~F.col("filled"), F.col("row_idx") != 1).otherwise((F.col("words") <= F.col("nums")) & (F.col("nums") > 0))
    g = rows.groupBy(*keys).agg(
        F.min(F.when(stop, F.col("row_idx"))).alias("stop"), F.count("*").alias("n"),
        F.max((F.col("row_idx") == 1) & ~F.col("filled")).alias("gap"))
    end = F.when(F.col("gap") & (F.col("n") <= 2), F.least("stop", F.lit(1))).otherwise(F.coalesce("stop", "n"))
    end = F.when(F.col("gap") & (end == 2), 1).otherwise(end)
    return g.select(*keys, F.greatest(end, F.lit(1)).cast("bigint").alias("n_headers"))


def header_rows_by_place(cells: DataFrame, keys: list[str], explicit: int = 0) -> DataFrame:
    """Header rows counted from the explicit ones on: rows 0 and 1 without digits count too."""
    t = tx.strip("text")
    digits = F.regexp_replace(t, r"[₩$€¥£\s,().\-–—]", "")
    numeric = (t != "") & nb.looks_numeric("text") & digits.rlike("^[0-9]+$")
    rows = cells.where(F.col("row_idx") < max(2, explicit)).groupBy(*keys, "row_idx").agg(F.max(numeric).alias("numeric"))
    g = rows.groupBy(*keys).agg(
        F.min(F.when((F.col("row_idx") >= explicit) & F.col("numeric"), F.col("row_idx"))).alias("stop"), F.max("row_idx").alias("last"))
    return g.select(*keys, F.greatest(F.coalesce("stop", F.col("last") + 1), F.lit(1)).cast("bigint").alias("n_headers"))


def source_unit(cells: DataFrame, keys: list[str], headers: int = 1) -> DataFrame:
    """Unit of a source table: its headers first, then its first two rows; won by default."""
    head, body = F.col("row_idx") < headers, (F.col("row_idx") >= headers) & (F.col("row_idx") < headers + 2)
    at = F.struct("row_idx", "col_idx")
    uh, ub = nb.unit_of_source_text("text"), nb.unit_of_source_text("text", body=True)
    return cells.groupBy(*keys).agg(F.coalesce(
        F.min_by(uh, F.when(head & uh.isNotNull(), at)), F.min_by(ub, F.when(body & ub.isNotNull(), at)), F.lit("won")).alias("unit"))


def template_unit(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Unit of a template table from its first three rows; thousand by default."""
    u = nb.unit_of_template_text("text")
    return cells.groupBy(*keys).agg(F.coalesce(
        F.min_by(u, F.when((F.col("row_idx") < 3) & u.isNotNull(), F.struct("row_idx", "cell_idx"))), F.lit("thousand")).alias("unit"))


def template_unit_text(cells: DataFrame, keys: list[str], headers: int = 1) -> DataFrame:
    """The last header text that reads like a unit note."""
    t, low = tx.strip("text"), F.lower(tx.strip("text"))
    shape = ((low.contains("in ") & (low.contains("won") | low.contains("thousand") | low.contains("million")))
             | (t.startswith("(") & low.contains("won")) | t.startswith("(in "))
    return cells.groupBy(*keys).agg(F.coalesce(
        F.max_by(t, F.when((F.col("row_idx") < headers) & shape, F.struct("row_idx", "cell_idx"))), F.lit("")).alias("unit_text"))


def source_period_columns(cells: DataFrame, keys: list[str], headers: int = 1) -> DataFrame:
    """Current and prior column of a source table; the last period-end header wins over the first plain one.

    Without any, three columns are label, current, prior and two are label, current.
    """
    t, at = tx.strip("text"), F.struct("row_idx", "col_idx")
    kind = (F.when(t.contains("당기말"), "ce").when(t.contains("전기말"), "pe").when(t.contains("당기"), "ca").when(t.contains("전기"), "pa"))
    h = cells.withColumn("k", F.when(F.col("row_idx") < headers, kind))

    def pick(fn, k):
        return fn("col_idx", F.when(F.col("k") == k, at))

    first_data = F.when(F.col("row_idx") == headers, F.col("col_idx"))
    g = h.groupBy(*keys).agg(
        F.coalesce(pick(F.max_by, "ce"), pick(F.min_by, "ca")).alias("c"), F.coalesce(pick(F.max_by, "pe"), pick(F.min_by, "pa")).alias("p"),
        (F.coalesce(F.max(first_data), F.lit(-1)) + 1).alias("width"))
    none = F.col("c").isNull() & F.col("p").isNull()
    return g.select(
        *keys, F.when(none & (F.col("width") >= 2), 1).otherwise(F.col("c")).cast("bigint").alias("cur_col"),
        F.when(none & (F.col("width") >= 3), 2).otherwise(F.col("p")).cast("bigint").alias("pri_col"))


def rolled_period_columns(cells: DataFrame, years: DataFrame, keys: list[str], headers: int = 2) -> DataFrame:
    """Period columns by years and markers, checked against the first ten data rows and their neighbours.

    ``years``: some of the keys plus old_current, old_prior, new_current, new_prior.
    """
    on = [c for c in keys if c in years.columns]
    t = tx.strip("text")
    h = cells.where((F.col("row_idx") < headers) & (t != "")).join(years, on)
    holds = lambda *names: _any([t.contains(F.col(n)) for n in names])
    marks = lambda words: _any([t.contains(w) for w in words])
    period = (F.when(holds("old_current", "new_current"), "current").when(holds("old_prior", "new_prior"), "prior")
              .when(marks(CURRENT_MARKS), "current").when(marks(PRIOR_MARKS), "prior"))
    cand = h.withColumn("period", period).where("period is not null").select(*keys, "row_idx", F.col("cell_idx").alias("col"), "period")
    filled = cells.where((F.col("row_idx") >= headers) & nb.has_amount("text")).select(
        *keys, F.col("cell_idx").alias("col")).distinct()
    tries = cand.withColumn("try", F.explode(F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(step).alias("step")) for rank, step in ((0, 0), (1, 1), (2, -1))])))
    hits = tries.select(*keys, "period", F.struct((F.col("try.rank") > 0).alias("moved"), F.col("row_idx"), F.col("col"), F.col("try.rank").alias("rank")).alias("pref"),
                        (F.col("col") + F.col("try.step")).alias("col")).join(filled, [*keys, "col"], "left_semi")
    return hits.groupBy(*keys, "period").agg(F.min_by("col", "pref").cast("bigint").alias("col"))


def data_start_row(cells: DataFrame, keys: list[str]) -> DataFrame:
    """First of rows 2 to 4 with two filled cells, else row 2."""
    rows = cells.where((F.col("row_idx") >= 2) & (F.col("row_idx") <= 4)).groupBy(*keys, "row_idx").agg(F.count_if(tx.strip("text") != "").alias("n"))
    starts = rows.where("n >= 2").groupBy(*keys).agg(F.min("row_idx").alias("s"))
    return cells.select(*keys).distinct().join(starts, keys, "left").select(*keys, F.coalesce("s", F.lit(2)).cast("bigint").alias("start_row"))


def data_columns(cells: DataFrame, keys: list[str], spacers: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """Current and prior physical columns: the first two cell positions that are mostly numeric."""
    body = cells.join(data_start_row(cells, keys), keys).where((F.col("row_idx") >= F.col("start_row")) & (F.col("cell_idx") > 0))
    if spacers is not None:
        body = body.join(spacers.select(*keys, F.col("phys_idx").alias("phys_col")), [*keys, "phys_col"], "left_anti")
    numeric = nb.is_amount_cell("text") & (tx.strip("text") != "")
    share = body.groupBy(*keys, "cell_idx").agg(F.avg(numeric.cast("double")).alias("share"))
    places = body.groupBy(*keys, "cell_idx", "phys_col").agg(F.count("*").alias("n"), F.min("row_idx").alias("first")).groupBy(*keys, "cell_idx").agg(
        F.max_by("phys_col", F.struct(F.col("n"), -F.col("first"))).alias("phys"))
    ok = share.where(F.col("share") >= least).join(places, [*keys, "cell_idx"])
    nth = ok.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("cell_idx"))).where("k <= 2")
    return nth.groupBy(*keys).agg(
        F.max(F.when(F.col("k") == 1, F.col("phys"))).alias("cur_col"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("phys"))), F.lit(-1)).cast("bigint").alias("pri_col"))


# --- amounts -----------------------------------------------------------------

def source_row_set(cells: DataFrame, keys: list[str], headers: int = 1) -> DataFrame:
    """Source rows as label, current and prior amount, with unit and total flags."""
    cols = source_period_columns(cells, keys, headers)
    body = cells.where(F.col("row_idx") >= headers).join(cols, keys).where("cur_col is not null")
    pick = lambda c: F.max(F.when(F.col("col_idx") == F.col(c), nb.parse_whole("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda x: x["text"]), " ")
    rows = body.groupBy(*keys, "row_idx").agg(
        F.max(F.when(F.col("col_idx") == 0, tx.strip("text"))).alias("label"), pick("cur_col").cast("bigint").alias("cur_amt"),
        pick("pri_col").cast("bigint").alias("pri_amt"), F.count("*").alias("n"), joined.alias("all_text"))
    rows = rows.where("n >= 2 and label <> ''").join(source_unit(cells, keys, headers), keys)
    return rows.select(*keys, "row_idx", "label", "cur_amt", "pri_amt", "unit", tx.is_total_text("all_text").alias("is_total"), tx.is_subtotal_text("all_text").alias("is_subtotal"))


def template_row_set(cells: DataFrame, keys: list[str], spacers: DataFrame | None = None) -> DataFrame:
    """Template rows with a label and at least one number, from tables of three rows or more."""
    big = cells.groupBy(*keys).agg(F.count_distinct("row_idx").alias("n")).where("n >= 3").select(*keys)
    # one row a table each, written before they meet the cells: a task holds the sorts of one of them at a time
    cells = cells.join(stored(big), keys, "left_semi")
    cols, starts = stored(data_columns(cells, keys, spacers)), stored(data_start_row(cells, keys))
    body = cells.join(cols, keys).join(starts, keys).where(F.col("row_idx") >= F.col("start_row"))
    pick = lambda c: F.max(F.when((F.col("phys_col") == F.col(c)) & (F.col("phys_col") > 0), nb.parse_whole("text"))).cast("bigint")
    rows = body.groupBy(*keys, "row_idx").agg(
        F.max(F.when(F.col("phys_col") == 0, tx.strip("text"))).alias("label"), pick("cur_col").alias("cur_amt"), pick("pri_col").alias("pri_amt"),
        F.first("cur_col").alias("cur_col"), F.first("pri_col").alias("pri_col"))
    return rows.where("label <> '' and (cur_amt is not null or pri_amt is not null)").join(template_unit(cells, keys), keys)


def table_values(cells: DataFrame, keys: list[str], first_row: int = 2, min_abs: int = 10) -> DataFrame:
    """Every number of a table from ``first_row`` on, with its place."""
    v = nb.parse_whole("text").cast("bigint")
    return once(cells.where(F.col("row_idx") >= first_row).select(*keys, "row_idx", "phys_col", v.alias("value")), "value").where(F.abs("value") >= max(min_abs, 1))


def labelled_values(cells: DataFrame, keys: list[str], first_row: int = 1) -> DataFrame:
    """Numbers with the label of their row: the row's first text that is no number, lower case."""
    t = tx.strip("text")
    rows = cells.where(F.col("row_idx") >= first_row).withColumn("value", nb.parse_source_amount(t))
    label = F.min(F.when((t != "") & F.col("value").isNull(), F.struct(F.col("col_idx"), F.lower(t).alias("t")))).over(Window.partitionBy(*keys, "row_idx"))
    return rows.withColumn("label", label["t"]).where("label is not null and value is not null").select(*keys, "row_idx", "col_idx", "label", F.col("value").cast("bigint").alias("value"))


def row_signatures(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered normalised numbers of each row."""
    sig = nb.number_signature("text")
    nums = F.transform(F.array_sort(F.collect_list(F.when(sig.isNotNull(), F.struct("col_idx", sig.alias("s"))))), lambda x: x["s"])
    return cells.groupBy(*keys, "row_idx").agg(nums.alias("numbers"))


def table_fingerprint(cells: DataFrame, keys: list[str], parse, limit: int | None = None) -> DataFrame:
    """Distinct non-zero numbers; with ``limit`` only those among the first so many in reading order."""
    v = parse("text").cast("bigint")
    n = cells.withColumn("value", v).where("value <> 0")
    if limit is not None:
        w = Window.partitionBy(*keys).orderBy("row_idx", "col_idx")
        n = n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return n.select(*keys, "value").distinct()


def numeric_columns(cells: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Columns with at least ``least`` numbers."""
    return cells.where(nb.parse_source_amount(tx.strip("text")).isNotNull()).groupBy(*keys, "col_idx").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drop_repeats(numbers: Column) -> Column:
    """Neighbouring equal numbers once, in rows of more than two numbers."""
    kept = F.filter(numbers, lambda x, i: (i == 0) | (x != F.coalesce(F.get(numbers, i - 1), x + 1)))
    return F.when(F.size(numbers) <= 2, numbers).otherwise(kept)


def population(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EMPTY, SPARSE (under 30 % filled) or POPULATED per table, header row left out."""
    t = tx.strip("text")
    num = nb.parse_report_number("text")
    total = F.count_if((t != "") & num.isNotNull())
    zero = F.count_if((num == 0) & t.isin(*nb.DASHES))
    g = cells.where("row_idx > 0").groupBy(*keys).agg(total.alias("n_numbers"), zero.alias("n_dashes"), F.count_if(t != "").alias("n_filled"), F.count("*").alias("n_cells"))
    share = F.col("n_numbers").cast("double") / F.col("n_cells").cast("double")
    return g.withColumn("status", F.when(F.col("n_numbers") == 0, "EMPTY").when(share < 0.3, "SPARSE").otherwise("POPULATED"))


def as_text_rows(cells: DataFrame, keys: list[str], order: str, limit: int = 50) -> DataFrame:
    """Rows as ``| a | b |``, the first ``limit`` of each table, with the table's row count."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("text").alias("t")))), lambda x: x["t"]), " | ")
    rows = cells.groupBy(*keys, "row_idx").agg(F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return row_position(rows, keys, "row_idx", "k").where(F.col("k") <= limit).drop("k").join(n, keys)


def uneven_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose rows differ in effective width, with the widths found."""
    rows = cells.groupBy(*keys, "row_idx").agg(F.sum("span").alias("width"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("width")).alias("w")).where(F.size("w") > 1)
    return g.select(*keys, F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("widths"))


def empty_tables(tables: DataFrame, cells: DataFrame, keys: list[str], headers: int = 1) -> DataFrame:
    """Tables without data rows: CRITICAL for statements, WARNING for notes.  ``tables``: keys, is_statement."""
    filled = cells.where((F.col("row_idx") >= headers)).select(*keys).distinct()
    return tables.join(filled, keys, "left_anti").select(*keys, F.when(F.col("is_statement"), "CRITICAL").otherwise("WARNING").alias("severity"))


def check_expected(cells: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected amounts against the cells at their place (``row_idx``, ``phys_col``, ``expected``)."""
    at = [*keys, "row_idx", "phys_col"]
    j = expected.join(cells.select(*at, nb.parse_whole_strict("text").cast("bigint").alias("actual")), at, "left")
    actual = F.coalesce("actual", F.lit(0))
    return j.select(*at, "expected", F.coalesce(F.abs(actual - F.col("expected")) <= 1, F.lit(False)).alias("ok"))
