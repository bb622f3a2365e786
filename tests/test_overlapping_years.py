"""Year rolling beside its SQL where old texts overlap."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.functions import dates

TEXTS = ["202019", "2022021", "no 202019 and 2022021.", "December 31, 2022021, 20202019", "Year ended December 31, 2020 19", "and 2022021, (2022 2021:", "", "x", "2019201920202020"]


@pytest.mark.parametrize("name", ["j07_replace_once", "j10_rolled_texts", "j10_roll_years_by_zone"])
def test_overlapping_years(spark, tmp_path, name):
    path = str(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's', 1)", [(i * 20 + k, t) for i, t in enumerate(TEXTS) for k in range(20)])
    con.execute(f"COPY documents TO '{path}' (FORMAT parquet)")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_private_letters_stay(spark):
    text = " 2020  2021"
    df = spark.createDataFrame([(text, [("2020", "2021"), ("2021", "2022")])], "t string, p array<struct<old string, new string>>")
    assert df.select(dates.replace_in_turn("t", df.p)).first()[0] == text.replace("2021", "2022").replace("2020", "2021")
