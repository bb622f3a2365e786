"""A whole change set applied to document bodies, by order keys instead of shifting indexes.

Every address means the body as it was before the change set. What stays keeps its place as a key, what is added gets the key of its anchor, a side and the number of its change; deletions only mark.
So nothing moves while changes are applied, and new places are counted once, at the end. Deletions come first, then updates, then additions (which clone what then stands there).

Elements: pair_id, pos, kind (paragraph|table|header), text
Cells:    pair_id, pos (of the table), row_idx, col_idx, text
Changes:  pair_id, change_no (unique within a pair, rising), type, pos, end_pos, row_idx, col_idx, side (before|after), value, old, new, values (map of texts).
Keys of ``values``: the column (add_row), the row (add_column), row:col (add_table), the distance from the block's first place (add_note).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import replace_once
from ledgerloom.functions.numbers import is_label_cell
from ledgerloom.operators.sequence import running_sum
from ledgerloom.session import stored

BODY = ["pair_id", "pos"]
ROW = [*BODY, "row_idx"]
COL = [*BODY, "col_idx"]
CELL = [*ROW, "col_idx"]

TYPES = ("update_values", "update_text", "add_row", "delete_row", "add_column", "add_table", "delete_table", "add_note", "delete_note", "restructure")
RANGES = ("add_note", "delete_note")


def covered(places: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The places (keys, pos) within any of ``ranges`` (keys, pos, end_pos): one sweep over places and range ends, however much ranges overlap."""
    step = F.explode(F.array(F.struct((2 * F.col("pos")).alias("at"), F.lit(1).alias("d")), F.struct((2 * F.col("end_pos") + 2).alias("at"), F.lit(-1).alias("d"))))
    ends = ranges.select(*keys, step.alias("x")).groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    spots = places.select(*keys, "pos").distinct().select(*keys, (2 * F.col("pos") + 1).alias("at"), F.lit(0).cast("bigint").alias("d"))
    open_now = running_sum(ends.unionByName(spots), keys, "at", F.col("d"), "open")
    return open_now.where("at % 2 <> 0 and open > 0").select(*keys, F.floor((F.col("at") - 1) / 2).cast("bigint").alias("pos"))


def numbered(variants: DataFrame, keys: list[str], at: str, order: list[str], out: str) -> DataFrame:
    """``variants`` with their new place from 0 within ``keys``: by anchor ``at``, side (-1, 0, 1) and ``order``. One row of counts an anchor goes through the running sum."""
    variants = stored(variants, *keys[:1])
    n = lambda side: F.count_if(F.col("side") == side)
    counts = variants.groupBy(*keys, at).agg(n(-1).alias("nb"), n(0).alias("nk"), n(1).alias("na"))
    base = running_sum(counts, keys, at, F.col("nb") + F.col("nk") + F.col("na"), "base", inclusive=False).select(*keys, at, "base", "nb", "nk")
    own = F.row_number().over(Window.partitionBy(*keys, at, "side").orderBy(*order)) - 1
    place = F.col("base") + F.when(F.col("side") >= 0, F.col("nb")).otherwise(0) + F.when(F.col("side") > 0, F.col("nk")).otherwise(0) + F.when(F.col("side") != 0, F.col("local")).otherwise(0)
    return variants.withColumn("local", own).join(base, [*keys, at]).withColumn(out, place.cast("bigint")).drop("local", "base", "nb", "nk")


@dataclass(frozen=True)
class ChangeLog:
    """A body and its changes; each method is one result."""

    elements: DataFrame
    cells: DataFrame
    changes: DataFrame

    @classmethod
    def of(cls, elements: DataFrame, cells: DataFrame, changes: DataFrame) -> ChangeLog:
        """With inputs written once, dealt by pair, as every result reads them several times."""
        return cls(*(stored(df, "pair_id") for df in (elements, cells, changes)))

    # --- what the changes address ---

    def _of(self, *types: str) -> DataFrame:
        return self.changes.where(F.col("type").isin(*types))

    def _bad_range(self) -> Column:
        return F.col("type").isin(*RANGES) & ~F.coalesce((F.col("pos") <= F.col("end_pos")), F.lit(False))

    def gone(self) -> DataFrame:
        """Elements (pair_id, pos) that a deleted table or note range covers."""
        return self._gone

    @cached_property
    def _gone(self) -> DataFrame:
        one = self._of("delete_table").join(self.elements.where("kind = 'table'").select(*BODY), BODY, "left_semi").select(*BODY, F.col("pos").alias("end_pos"))
        block = self._of("delete_note").where(~self._bad_range()).select(*BODY, "end_pos")
        return stored(covered(self.elements, one.unionByName(block), ["pair_id"]), "pair_id")

    def _doomed(self) -> DataFrame:
        return self._of("delete_row").select(*ROW).distinct()

    def failures(self) -> DataFrame:
        """(pair_id, change_no, type, problem) of every change that has no effect, with the first reason that holds."""
        spots = self.elements.select(*BODY, F.col("kind"))
        held = lambda keys, name: self.cells.select(*keys).distinct().withColumn(name, F.lit(True))
        c = self.changes.join(spots, BODY, "left").join(self.gone().withColumn("gone", F.lit(True)), BODY, "left")
        c = c.join(held(ROW, "has_row"), ROW, "left").join(held(COL, "has_col"), COL, "left")
        c = c.join(self.cells.select(*CELL, is_label_cell("text").alias("label")), CELL, "left")
        c = c.join(self._doomed().withColumn("doomed", F.lit(True)), ROW, "left")
        within = self.elements.groupBy("pair_id").agg(F.min("pos").alias("least"), F.max("pos").alias("most"))
        c = c.join(within, "pair_id", "left")
        kind, is_type = F.col("kind"), lambda *t: F.col("type").isin(*t)
        on_table = is_type("update_values", "add_row", "delete_row", "add_column", "add_table", "delete_table")
        rules = [
            ("unknown type", ~F.coalesce(is_type(*TYPES), F.lit(False))),
            ("bad range", self._bad_range()),
            ("no such element", is_type(*RANGES) & (F.col("least").isNull() | (F.col("end_pos") < F.col("least")) | (F.col("pos") > F.col("most")))),
            ("no such element", ~is_type(*RANGES, "restructure") & kind.isNull()),
            ("not a table", on_table & (kind != "table")),
            ("not a text", is_type("update_text") & (kind == "table")),
            ("was deleted", is_type("update_values", "update_text", "add_row", "add_column") & F.col("gone").isNotNull()),
            ("no such row", is_type("update_values", "add_row", "delete_row") & F.col("has_row").isNull()),
            ("no such column", is_type("add_column") & F.col("has_col").isNull()),
            ("row was deleted", is_type("update_values") & F.col("doomed").isNotNull()),
            ("no such cell", is_type("update_values") & F.col("label").isNull()),
            ("a label stands there", is_type("update_values") & F.col("label")),
        ]
        problem = reduce(lambda w, r: w.when(F.coalesce(r[1], F.lit(False)), r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
        return c.select("pair_id", "change_no", "type", problem.alias("problem")).where("problem is not null")

    # --- texts after the updates ---

    def _cell_texts(self) -> DataFrame:
        """Cells with their updated text: the last change of a cell holds, labels stay; what is deleted takes no updates, not even for its clones."""
        live = self._of("update_values").join(self.gone(), BODY, "left_anti").join(self._doomed(), ROW, "left_anti")
        last = live.groupBy(*CELL).agg(F.max_by("value", "change_no").alias("value"))
        text = F.when(F.col("value").isNotNull() & ~is_label_cell("text"), F.col("value")).otherwise(F.col("text"))
        return self.cells.join(last, CELL, "left").withColumn("text", text).drop("value")

    def _element_texts(self) -> DataFrame:
        """Elements with their updated text; headers take the old and new texts of restructure changes, all at once."""
        last = self._of("update_text").join(self.gone(), BODY, "left_anti").groupBy(*BODY).agg(F.max_by("value", "change_no").alias("value"))
        pair = F.struct("change_no", "old", "new")
        pairs = self._of("restructure").where("old <> ''").groupBy("pair_id").agg(F.sort_array(F.collect_set(pair)).alias("pairs"))
        e = self.elements.join(last, BODY, "left").join(pairs, "pair_id", "left")
        plain = F.when(F.col("value").isNotNull() & (F.col("kind") != "table"), F.col("value")).otherwise(F.col("text"))
        e = e.withColumn("text", plain)
        return e.withColumn("text", F.when((F.col("kind") == "header") & F.col("pairs").isNotNull(), replace_once("text", F.col("pairs"))).otherwise(F.col("text"))).drop("value", "pairs")

    # --- what stays and what is cloned ---

    def _places(self) -> DataFrame:
        """Elements that stay and clones of elements: pair_id, model, anchor, side, no, nth, values, added, pos (new)."""
        side = F.when(F.col("side") == "before", -1).otherwise(1).alias("side")
        stay = self.elements.join(self.gone(), BODY, "left_anti").select(
            "pair_id", F.col("pos").alias("model"), F.col("pos").alias("anchor"), F.lit(0).alias("side"), F.lit(-1).cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("nth"), F.lit(None).cast("map<string,string>").alias("values"))
        spots = self.elements.select("pair_id", F.col("pos").alias("model"))
        tables = self._of("add_table").select("pair_id", F.col("pos").alias("model"), F.col("pos").alias("anchor"), side, F.col("change_no").cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("nth"), "values")
        tables = tables.join(self.elements.where("kind = 'table'").select("pair_id", F.col("pos").alias("model")), ["pair_id", "model"], "left_semi")
        # a note's block: only its own places, within the body; the clones' number is the size of the result
        within = self.elements.groupBy("pair_id").agg(F.min("pos").alias("least"), F.max("pos").alias("most"))
        notes = self._of("add_note").where(~self._bad_range()).join(within, "pair_id").withColumns({"lo": F.greatest("pos", "least"), "hi": F.least("end_pos", "most")}).where("lo <= hi")
        notes = notes.withColumn("model", F.explode(F.sequence("lo", "hi"))).join(spots, ["pair_id", "model"], "left_semi")
        anchor = F.when(F.col("side") == "before", F.col("lo")).otherwise(F.col("hi"))
        notes = notes.select("pair_id", "model", anchor.alias("anchor"), side, F.col("change_no").cast("bigint").alias("no"), (F.col("model") - F.col("pos")).alias("nth"), "values")
        return numbered(stay.unionByName(tables).unionByName(notes), ["pair_id"], "anchor", ["no", "nth"], "pos").withColumn("added", F.col("side") != 0)

    def body(self) -> DataFrame:
        """(pair_id, pos, kind, text, added): the elements in their new places."""
        texts = self._element_texts().withColumnRenamed("pos", "model")
        text = F.when(F.col("kind") != "table", F.coalesce(F.try_element_at("values", F.col("nth").cast("string")), F.col("text"))).otherwise(F.col("text"))
        return self._places().join(texts, ["pair_id", "model"]).select("pair_id", "pos", "kind", text.alias("text"), "added")

    def _variants(self, keys: list[str], index: str, stay: DataFrame, kind: str, out: str) -> DataFrame:
        """Rows or columns that stay, and additions beside them, with their new index."""
        model = stay.select(*keys, index, F.lit(0).alias("side"), F.lit(-1).cast("bigint").alias("no"), F.lit(None).cast("map<string,string>").alias("values"))
        known = self.cells.select(*keys, index).distinct()
        more = self._of(kind).join(known, [*keys, index], "left_semi").select(*keys, index, F.when(F.col("side") == "before", -1).otherwise(1).alias("side"), F.col("change_no").cast("bigint").alias("no"), "values")
        return numbered(model.unionByName(more), keys, index, ["no"], out)

    def tables(self) -> DataFrame:
        """(pair_id, pos, row_idx, col_idx, text, added): the cells in their new places.

        A row added beside a deleted one clones it as it was; a cell of an added row within an added column takes the row's text. Clones of tables and notes hold the rows that stay, with their updated texts, and
        not what the same change set adds to their model.
        """
        cells, doomed = stored(self._cell_texts(), "pair_id"), self._doomed()
        rows_left = self.cells.select(*ROW).distinct().join(doomed, ROW, "left_anti")
        rows = self._variants(BODY, "row_idx", rows_left, "add_row", "new_row").select(*ROW, F.col("side").alias("row_side"), F.col("values").alias("row_values"), "new_row")
        cols = self._variants(BODY, "col_idx", self.cells.select(*COL).distinct(), "add_column", "new_col").select(*COL, F.col("side").alias("col_side"), F.col("values").alias("col_values"), "new_col")
        places = stored(self._places(), "pair_id")
        stay = places.where("not added").select("pair_id", F.col("model").alias("pos"), F.col("pos").alias("new_pos"))
        grid = cells.join(stay, BODY).join(rows, ROW).join(cols, COL)
        given = F.coalesce(
            F.when(F.col("row_side") != 0, F.try_element_at("row_values", F.col("col_idx").cast("string"))),
            F.when(F.col("col_side") != 0, F.try_element_at("col_values", F.col("row_idx").cast("string"))), F.col("text"))
        kept = grid.select("pair_id", F.col("new_pos").alias("pos"), F.col("new_row").alias("row_idx"), F.col("new_col").alias("col_idx"), given.alias("text"), ((F.col("row_side") != 0) | (F.col("col_side") != 0)).alias("added"))
        plain = lambda v, key, new: numbered(v.withColumns({"side": F.lit(0), "no": F.lit(0)}), BODY, key, ["no"], new).select(*BODY, key, new)
        clones = places.where("added").select("pair_id", F.col("model").alias("pos"), F.col("pos").alias("new_pos"), "values")
        copy = cells.join(clones, BODY).join(plain(rows_left, "row_idx", "new_row"), ROW).join(plain(self.cells.select(*COL).distinct(), "col_idx", "new_col"), COL)
        text = F.coalesce(F.try_element_at("values", F.concat_ws(":", "row_idx", "col_idx")), F.col("text"))
        return kept.unionByName(copy.select("pair_id", F.col("new_pos").alias("pos"), F.col("new_row").alias("row_idx"), F.col("new_col").alias("col_idx"), text.alias("text"), F.lit(True).alias("added")))
