"""Parsed texts are worked out once a row: no condition holds a parser, so Spark doesn't parse again to filter."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions.numbers import parse_whole
from ledgerloom.session import once

SF = "/root/testdata/sf0.001"


def nodes(df):
    """The nodes of the plan, each with its line breaks."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return re.split(r"\n[ :]*[+:]- ", shown.getvalue())


def conditions(df):
    return [n for n in nodes(df) if re.match(r"(\*\(\d+\) )?Filter ", n)]


def test_once_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "(1,000)", "a"), (2, "x", "b"), (3, None, "c")], "k int, t string, z string").select("k", parse_whole("t").cast("bigint").alias("v"), "z", F.upper("z").alias("u"))
    kept = once(df, "v", "u")
    assert kept.columns == ["k", "v", "z", "u"]
    assert sorted(map(tuple, kept.collect())) == [(1, -1000, "a", "A"), (2, None, "b", "B"), (3, None, "c", "C")]
    assert any("regexp" in c for c in conditions(df.where("v < 0")))
    assert not any("regexp" in c for c in conditions(kept.where("v < 0")))


@pytest.mark.parametrize("name", ["c21_compare_cells", "a24_table_values", "c16_align_columns"])
def test_conditions_hold_no_parser(spark, name):
    assert not [c for c in conditions(entry.queries()[name](spark, SF)) if re.search("regexp_replace|try_cast|format_number", c)]


def test_numbers_are_parsed_in_one_place(spark):
    assert len([n for n in nodes(entry.queries()["i12_glossary_by_signature"](spark, SF)) if "[△▲]" in n]) == 1
