"""A cross-section of the registered queries against their oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.views import TABLES
from tools.compare import rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship_match_and_verify", "c03_table_match_prior_value", "c04_table_match_fingerprint", "c05_table_match_other_unit", "c10_row_dedup_prior_value", "c11_rows_exact_label",
    "c14_zip_tables", "c21_compare_cells", "c26_match_by_number_share", "a09_segment_notes", "a10_segment_sections", "a15_resolve_grid", "a20_title_context", "s04_parse_whole",
    "s35_label_similarity", "v01_check_cells", "v02_column_shift", "v03_repair", "e10_balance_sheet", "e12_cash_flow", "e22_statement_compare", "j07_replace_once", "j12_delete_rows",
    "j13_add_rows", "w12_shift_positions", "i03_longest_contained", "i06_translate_labels", "i15_glossary_by_rows", "x01_multiset_compare", "t02_latest_state", "t05_until_terminal",
    "t06_transitions", "t05_stream_until_terminal", "t06_lifecycle", "t06_stream_lifecycle", "t08_stream_retention", "t09_stream_upsert", "p06_archive_validity",
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    cur = sql.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows(cur.fetchall(), cols)
    assert want and rows([tuple(r) for r in df.collect()], df.columns) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
