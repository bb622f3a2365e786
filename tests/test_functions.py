"""Literal vectors for numbers, labels, dates and addresses."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.streaming.jobs import estimated_progress


def column(spark, values, fn, ty="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ty}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_convert_unit(spark):
    rows = [(1234567, "won", "thousand", 1235), (1000, "won", "thousand", 1), (500, "won", "thousand", 1), (499, "won", "thousand", 0), (None, "won", "thousand", None),
            (100, "thousand", "thousand", 100), (5, "thousand", "won", 5000), (1500000, "won", "million", 2), (1500, "thousand", "million", 2),
            (-1234567, "won", "thousand", -1235), (-500, "won", "thousand", -1), (0, "won", "thousand", 0)]
    df = spark.createDataFrame(rows, "v bigint, a string, b string, want bigint")
    got = df.select(nb.convert_unit("v", "a", "b").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_parse_whole(spark):
    values = ["1,234", "(1,234)", "△1,234", "▲1,234", "-", "—", "–", "", "some text", "0", "1,234,567,890", "  1,234  ", "-1234", "12.9", "(△5)", "\\ 7"]
    want = [1234, -1234, -1234, -1234, 0, 0, 0, 0, None, 0, 1234567890, 1234, -1234, 12, -5, 7]
    assert [None if v is None else int(v) for v in column(spark, values, nb.parse_whole)] == want


def test_round_trip(spark):
    assert column(spark, ["1,234", "(1,234)", "-", "0"], lambda c: nb.format_amount(nb.parse_whole(c))) == ["1,234", "(1,234)", "-", "-"]


def test_format_amount(spark):
    values = [1234567, -1234, 0, None, 5, -5, -1234567890]
    assert column(spark, values, nb.format_amount, "bigint") == ["1,234,567", "(1,234)", "-", "-", "5", "(5)", "(1,234,567,890)"]


def test_amount_cells(spark):
    yes = ["1,234", "(1,234)", "-", "", "—", "–", "△1,234", "1234", "   "]
    no = ["Total Assets", "Net Income", "...x"]
    assert column(spark, yes, nb.is_amount_cell) == [True] * len(yes)
    assert column(spark, no, nb.is_amount_cell) == [False] * len(no)


def test_parse_source_amount(spark):
    got = column(spark, ["1,234,567", "(1,234,567)", "-", "", "\\  2,938,755", "1.5", "(-5)", "12 3", "1e5"], nb.parse_source_amount)
    assert [None if v is None else float(v) for v in got] == [1234567, -1234567, 0, None, 2938755, 1.5, 5, None, None]


def test_signature_and_report_numbers(spark):
    assert column(spark, ["(1,234)", "-", "abc12", "12.50", "1.2.3", "△5"], nb.number_signature) == ["-1234", None, "12", "12.5", None, "5"]
    got = column(spark, ["12.5%", "Net", "-", "(3)", "-4", ""], nb.parse_report_number_or_percent)
    assert [None if v is None else float(v) for v in got] == [12.5, None, 0, -3, -4, None]


def test_amounts_match(spark):
    df = spark.createDataFrame([(1, 2, True), (1, 3, False), (None, None, True), (0, None, True), (None, 0, True), (None, 5, False)], "a bigint, b bigint, want boolean")
    assert all(r.g == r.want for r in df.select(nb.amounts_match("a", "b").alias("g"), "want").collect())


def test_note_numbers(spark):
    got = column(spark, ["1. General Information", "General Information", "2.1 Basis of Preparation"], lambda c: tx.note_number(c, F.lit(7)))
    assert [(r.number, r.title) for r in got] == [("1", "General Information"), ("7", "General Information"), ("2.1", "Basis of Preparation")]
    got = column(spark, ["1. 일반사항", "2.1.1 세부", "2.1 항목", "(3) 소제목", "⑫ 항목", "가. 항목", "본문"], tx.note_numbering)
    assert [r and (r.number, r.depth) for r in got] == [("1", 0), ("2.1.1", 2), ("2.1", 1), ("3", 1), ("12", 2), ("가", 2), None]


def test_addresses(spark):
    assert column(spark, ["table:5:row:3:col:2", "header"], tx.parse_address) == [{"table": "5", "row": "3", "col": "2"}, {"header": "true"}]


def test_dates(spark):
    got = column(spark, ["2025년 12월 31일", "2025년 1월 2일 현재", "제 5 기"], d.translate_date)
    assert got == ["December 31, 2025", "As at January 2, 2025", None]


def test_replacement_does_not_cascade(spark):
    pairs = [{"old": "2024", "new": "2025"}, {"old": "2023", "new": "2024"}, {"old": "December 31, 2023", "new": "December 31, 2024"}]
    df = spark.createDataFrame([("December 31, 2024 and 2023; December 31, 2023", pairs)], "t string, p array<struct<old:string,new:string>>")
    assert df.select(d.replace_once("t", F.col("p"))).first()[0] == "December 31, 2025 and 2024; December 31, 2024"


def test_prose_keeps_founding_years(spark):
    df = spark.createDataFrame([("Founded 2024 in Seoul, see 2024. and 2023",)], "t string")
    pairs = d.roll_pairs_in_prose(F.make_date(F.lit(2025), F.lit(12), F.lit(31)))
    assert df.select(d.replace_once("t", pairs)).first()[0] == "Founded 2024 in Seoul, see 2025. and 2024"


def test_model_answers(spark):
    got = column(spark, ['```json\n["a", "b"]\n```', '["c"]', "1. x\n2. y", "plain"], tx.json_list)
    assert got == [["a", "b"], ["c"], ["x", "y"], None]
    got = column(spark, ['{"action": "read"}', 'so ```json\n{"action": "w"}\n``` ok', 'x {"a": 1} {"action": "z"}', "no"], tx.json_action)
    assert got == ["read", "w", "z", "_retry"]


@pytest.mark.parametrize("message,want", [("구조 분석 시작", 5), ("테이블 매칭", 15), ("재무상태표 처리", 25), ("포괄손익", 35), ("자본변동", 45), ("현금흐름", 55), ("주석 5", 65),
                                          ("Year rolling", 80), ("Validation", 90), ("저장", 95), ("other", None)])
def test_progress_words(spark, message, want):
    assert column(spark, [message], estimated_progress) == [want]


def test_label_similarity(spark):
    rows = [("Total assets", "total assets:", None, 1.0), ("cash", "cash flow", None, 0.7 + 0.3 * (4 / 9)), ("자산", "Assets", "assets", 0.95), ("a b c", "b c d", None, 0.5), ("x", "", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, en string, want double")
    got = tx.with_label_similarity(df, "a", "b", "sim", read_a="en").collect()
    assert all(abs(r.sim - r.want) < 1e-12 for r in got)


def test_extensions(spark):
    assert column(spark, ["a.DSD", "b/c.zip", "d.docx"], lambda c: tx.has_extension(c, [".dsd", ".zip"])) == [True, True, False]
