"""Nothing is cut away: whole labels, all numbers, all rows, absent columns."""

from ledgerloom.operators import cells, changes, compare, glossary, quality, rows, verify
from ledgerloom.sources import documents


def test_labels_that_differ_late(spark):
    start = "x" * 30
    src = spark.createDataFrame([(1, 0, start + "AAA"), (1, 1, "total assets")], "pair_id int, src_row int, src_label string")
    tpl = spark.createDataFrame([(1, 0, "zz " + start + "BBB"), (1, 1, "net total assets")], "pair_id int, tpl_row int, tpl_label string")
    assert {(r.src_row, r.tpl_row) for r in rows.first_label_hit(src, tpl, ["pair_id"]).collect()} == {(0, None), (1, 1)}


def test_numbers_after_the_thirtieth(spark):
    left = [(1, 1, i, 0, 1000 + i) for i in range(40)] + [(1, 1, 100 + i, 0, 5000 + i) for i in range(40)]
    right = [(1, 7, i, 0, 9000 + i) for i in range(40)] + [(1, 7, 100 + i, 0, 5000 + i) for i in range(40)]
    a = spark.createDataFrame(left, "pair_id int, l int, row_idx int, col_idx int, value int")
    b = spark.createDataFrame(right, "pair_id int, r int, row_idx int, col_idx int, value int")
    sizes = spark.createDataFrame([(1, "l", 1, 80), (1, "r", 7, 80)], "pair_id int, side string, id int, n_rows int")
    assert [(r.l, r.r, r.score) for r in compare.match_by_number_share(a, b, sizes).collect()] == [(1, 7, 0.5)]


def test_column_numeric_after_row_25(spark):
    body = [(1, i, c, c, "label" if c == 0 or i < 26 else str(i)) for i in range(120) for c in (0, 1)]
    df = spark.createDataFrame(body, "t int, row_idx int, cell_idx int, phys_col int, text string")
    assert [r.cur_col for r in cells.data_columns(df, ["t"]).collect()] == [1]


def test_absent_columns_and_repeated_updates(spark):
    filled = spark.createDataFrame([(1, 0, False, ["a", "5", ""], 5, 7, "5", "", True, False)], "tbl int, row int, is_total boolean, row_texts array<string>, exp_cur int, exp_pri int, cur_text string, pri_text string, has_cur boolean, has_pri boolean")
    assert [(r.col_name, r.verdict) for r in verify.check_cells(filled, ["tbl"]).collect()] == [("current", "correct")]
    cell = dict.fromkeys(changes.CELL, 1)
    updates = spark.createDataFrame([(*cell.values(), "8", 2), (*cell.values(), "9", 1)], [*cell, "value", "change_no"])
    base = spark.createDataFrame([(*cell.values(), "1")], [*cell, "text"])
    assert [changes.update_cells(base, u).first().text for u in (updates, updates.orderBy("change_no"))] == ["8", "8"]


def test_context_letters_late_in_a_text(spark):
    entries = spark.createDataFrame([("가 나", "one", 1), ("다", "two", 2), ("가나 라", "three", 3)], "ko string, en string, ord long")
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    shown = lambda t, **k: {(r.en, r.hits) for r in glossary.context_entries(entries, t, "text", **k).collect()}
    assert shown(texts("x" * 40 + "라나", " ", None)) == {("one", 1), ("three", 2)}
    assert shown(texts("x" * 40 + "라나"), limit=1) == {("three", 2)}
    assert shown(texts("xyz ")) == {("one", 0), ("two", 0), ("three", 0)}
    assert shown(texts(), fallback=2) == {("one", 0), ("two", 0)}
    assert glossary.context_entries(entries.where("false"), texts("가"), "text").count() == 0


def test_metadata_told_late(spark):
    lines = [(1, i, "Body", "x", "f.docx") for i in range(60)] + [(1, 60, "Body", "Acme Holdings Co., Ltd. and subsidiaries", "f.docx"), (1, 61, "Body", "December 31, 2024 and 2023, consolidated", "f.docx")]
    df = spark.createDataFrame(lines, "doc_id int, seq int, style string, text string, file_name string")
    r = documents.template_metadata(df).first()
    assert (r.doc_type, r.period_current, r.period_prior) == ("consolidated", "2024", "2023") and r.company.startswith("Acme Holdings")
    assert documents.template_metadata(df, within=50, company_within=20).first().period_current is None


def test_third_numbers_are_compared(spark):
    rows = lambda *r: spark.createDataFrame(r, "t int, row_idx int, nums array<int>")
    a, b = rows((1, 1, [1, 2, 3]), (1, 2, [1, 2, 3]), (1, 3, [7]), (1, 4, []), (1, 5, [1])), rows((1, 1, [1, 2, 4]), (1, 2, [1, 2, 3]), (1, 3, [7, 8]), (1, 4, [1]))
    told = lambda **k: [r.status for r in quality.compare_statement_rows(a, b, ["t"], **k).orderBy("row_idx").collect()]
    assert told() == ["WRONG", "OK", "OK", "WRONG", "MISSING"] and told(numbers=2) == ["OK", "OK", "OK", "WRONG", "MISSING"]


def test_leftover_rows_are_all_returned(spark):
    src, tpl = spark.createDataFrame([(1, i) for i in range(9)], "t int, src_row int"), spark.createDataFrame([(1, 5)], "t int, tpl_row int")
    none = spark.createDataFrame([], "t int, src_row int, tpl_row int")
    got = {(r.src_row, r.tpl_row) for r in changes.leftover_rows_by_place(src, tpl, none, ["t"]).collect()}
    assert got == {(0, 5), *((i, None) for i in range(1, 9))}
    assert changes.leftover_rows_by_place(src, tpl, none, ["t"], slack=0.5).count() == 0
