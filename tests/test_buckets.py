"""Inputs beyond one task: what is dealt by pair is written in buckets and never dealt anew."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import session
from ledgerloom.plans.views import TABLES
from tools.compare import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 2_000)
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    spark.conf.set("ledgerloom.bucketed", "false")


@pytest.mark.parametrize("name", ["j16_apply_changes", "j16_log_tables", "j16_log_body", "v04_reverify"])
def test_nothing_is_dealt_anew(spark, name):
    df = entry.queries()[name](spark, SF)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    assert "Exchange" not in shown.getvalue()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stored_")]


@pytest.mark.parametrize("name", ["j16_apply_changes", "j16_log_tables", "j16_log_body", "b04_action_list", "c12_rows_similar_label", "x05_unresolved"])
def test_same_results_in_buckets(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = rows(cur.fetchall(), cols)
    assert want and rows([tuple(r) for r in df.collect()], df.columns) == want
