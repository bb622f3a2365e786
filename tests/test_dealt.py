"""Views whose rows are dealt by pair once, and stay there."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import views
from ledgerloom.session import TASK_ROWS, keep_dealt

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(views.SPARK_VIEWS))
def test_views_for_spark_hold_the_same_rows(spark, name):
    got = views.open_views(spark, SF, [name])[0]
    want = spark.sql(views._render(views.VIEWS[name], False))
    assert got.schema.simpleString() == want.schema.simpleString() and got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["j02_fill_by_position", "j12_delete_rows", "j13_add_rows", "j11_update_cells"])
def test_joins_deal_by_pair_alone(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            entry.queries()[name](spark, SF).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in shown.getvalue().splitlines() if "Exchange" in line]
    assert moved and all(re.search(r"hashpartitioning\(pair_id#\d+L, \d+\)", line) for line in moved)


def test_parts_follow_the_input(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        keep_dealt(spark, TASK_ROWS * 50 + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "51"
        keep_dealt(spark, 10)
        assert spark.conf.get("spark.sql.shuffle.partitions") == own
        spark.conf.unset("spark.sql.shuffle.partitions")
        keep_dealt(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        keep_dealt(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def _joins(spark, df):
    df.collect()
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return re.findall(r"BroadcastHashJoin|SortMergeJoin", shown.getvalue().split("== Initial Plan ==")[0])


def test_broadcast_follows_counted_rows(spark, tmp_path):
    sizes, counted = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    keep_dealt(spark)
    own = spark.conf.get(sizes)
    try:
        spark.conf.set(sizes, "1m")
        # 1000 times the bytes of its file
        spark.range(100_000).selectExpr("id % 7 AS k", "repeat('x', 100) AS text").write.parquet(f"{tmp_path}/t")
        rows = spark.read.parquet(f"{tmp_path}/t")
        both = lambda: rows.join(rows.withColumnRenamed("text", "other"), "k").limit(3)
        assert _joins(spark, both()) == ["BroadcastHashJoin"]
        keep_dealt(spark, TASK_ROWS + 1)
        assert _joins(spark, both()) == ["SortMergeJoin"]  # neither side's rows are within 1 MB, though both files are
        assert _joins(spark, rows.join(rows.groupBy("k", "text").count(), ["k", "text"])) == ["BroadcastHashJoin"]
        keep_dealt(spark)
        assert spark.conf.get(sizes) == "1m" and spark.conf.get(counted, None) is None
        spark.conf.set(counted, "5m")
        keep_dealt(spark, TASK_ROWS + 1)
        assert spark.conf.get(counted) == "5m"
        keep_dealt(spark)
        assert (spark.conf.get(sizes), spark.conf.get(counted)) == ("1m", "5m")
    finally:
        keep_dealt(spark)
        spark.conf.unset(counted)
        spark.conf.set(sizes, own)
