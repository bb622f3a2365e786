"""Quality of a finished report against its source and template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_bucket(score: Column) -> Column:
    return F.when(score >= 0.95, "PERFECT").when(score >= 0.7, "HIGH").when(score >= 0.5, "PARTIAL").otherwise("LOW")


def multiset_compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Shared, missing and extra values per key, repeats counted.  Both: keys, value."""
    a = left.groupBy(*keys, "value").agg(F.count("*").alias("na"))
    b = right.groupBy(*keys, "value").agg(F.count("*").alias("nb"))
    j = a.join(b, [*keys, "value"], "full_outer").na.fill(0, ["na", "nb"])
    return j.groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("matched"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("missing"),
                                F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("extra"))


def set_compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with their side: common, left or right."""
    a = left.select(*keys, "value").distinct().withColumn("a", F.lit(1))
    b = right.select(*keys, "value").distinct().withColumn("b", F.lit(1))
    j = a.join(b, [*keys, "value"], "full_outer")
    return j.select(*keys, "value", F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("common").alias("side"))


def largest(values: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """The ``limit`` values of greatest magnitude per key."""
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), F.col("value"))
    return values.withColumn("k", F.row_number().over(w).cast("bigint")).where(F.col("k") <= limit)


def error_pattern(exp_cur: Column, exp_pri: Column, found: Column) -> Column:
    """sign, prior_in_current, factor or different, in this order."""
    ratio = F.abs(found.cast("double") / F.nullif(exp_cur, F.lit(0)).cast("double"))
    factor = (exp_cur != 0) & (found != 0) & ratio.isin(1000.0, 0.001, 1000000.0, 0.000001)
    return (F.when(exp_cur.isNull() | found.isNull(), "different").when(exp_cur == -found, "sign").when(exp_pri == found, "prior_in_current")
            .when(factor, "factor").otherwise("different"))


def compare_statement_rows(src: DataFrame, out: DataFrame, keys: list[str], numbers: int | None = None) -> DataFrame:
    """Rows by place: OK when the output begins with all numbers of the source row (the first ``numbers`` of them, if given), else WRONG or MISSING.  Both: keys, row_idx, nums."""
    j = src.withColumnRenamed("nums", "a").join(out.withColumnRenamed("nums", "b"), [*keys, "row_idx"], "left")
    na, nb = F.size("a"), F.size("b")
    n = na if numbers is None else F.least(na, F.lit(numbers))
    same = F.when(na > 0, (nb >= n) & (F.slice("a", 1, n) == F.slice("b", 1, n))).otherwise(nb == 0)
    return j.select(*keys, "row_idx", F.when(F.col("b").isNull(), "MISSING").when(same, "OK").otherwise("WRONG").alias("status"))


def accuracy(compared: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    g = compared.groupBy(*keys).agg(n("OK").alias("n_ok"), n("WRONG").alias("n_wrong"), n("MISSING").alias("n_missing"), F.count("*").alias("n_rows"))
    return g.withColumn("accuracy", F.col("n_ok").cast("double") / F.col("n_rows").cast("double"))


def check_total_rows(totals: DataFrame, out_totals: DataFrame, out_numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Total rows of the source: correct if a total row (>= 90 %), or the table at large (>= half), holds their values.

    ``totals``/``out_totals``: keys, row_idx, value; ``out_numbers``: keys, value.
    The first output total sharing at least half decides.
    """
    a = totals.select(*keys, F.col("row_idx").alias("ra"), "value").distinct()
    n = a.groupBy(*keys, "ra").agg(F.count("*").alias("n"))
    b = out_totals.select(*keys, F.col("row_idx").alias("rb"), "value").distinct()
    share = lambda c: F.col(c).cast("double") / F.col("n").cast("double")
    hit = a.join(b, [*keys, "value"]).groupBy(*keys, "ra", "rb").agg(F.count("*").alias("c")).join(n, [*keys, "ra"]).withColumn("o", share("c")).where("o >= 0.5")
    first = hit.groupBy(*keys, "ra").agg(F.min_by("o", "rb").alias("o"))
    anyw = a.join(out_numbers.select(*keys, "value").distinct(), [*keys, "value"], "left_semi").groupBy(*keys, "ra").agg(F.count("*").alias("g"))
    j = n.join(first, [*keys, "ra"], "left").join(anyw, [*keys, "ra"], "left")
    ok = F.when(F.col("o").isNotNull(), F.col("o") >= 0.9).otherwise(F.coalesce(share("g"), F.lit(0.0)) >= 0.5)
    return j.select(*keys, F.col("ra").alias("row_idx"), F.when(ok, "correct").otherwise("wrong").alias("status"))


def year_change(before: Column, after: Column, old_cur: Column, new_cur: Column, old_pri: Column, new_pri: Column) -> Column:
    """current, prior, other, or NULL for an unchanged text."""
    exact = lambda o, n: (before == o) & (after == n)
    part = lambda o, n: before.contains(o) & after.contains(n) & (F.replace(before, o, n) == after)
    return (F.when(before == after, None).when(exact(old_cur, new_cur), "current").when(exact(old_pri, new_pri), "prior")
            .when(part(old_cur, new_cur), "current").when(part(old_pri, new_pri), "prior").otherwise("other"))


def table_changes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """What happened to each table between template and result.

    ``cells``: keys, row_idx, before, after, before_num, after_num.
    """
    changed = F.col("before") != F.col("after")
    any_num = changed & (F.col("before_num").isNotNull() | F.col("after_num").isNotNull())
    new_num = changed & F.col("after_num").isNotNull()
    digits = F.regexp_replace("after", "202[345]", "").rlike("[0-9]{2,}")
    g = cells.groupBy(*keys).agg(F.count_if(changed).alias("n_changed"), F.count_if(any_num).alias("n_numeric"), F.count_if(new_num).alias("n_new"),
                                 F.max(digits).alias("has_numbers"), F.count_distinct("row_idx").alias("n_rows"))
    status = F.when(F.col("n_numeric") > 0, "DATA_UPD").when(F.col("n_changed") > 0, "TEXT_UPD").otherwise("unchanged")
    stale = F.when((F.col("n_new") == 0) & (F.col("n_rows") >= 3), F.when(F.col("has_numbers"), "HAS_PRIOR_DATA").otherwise("NO_DATA"))
    return g.select(*keys, "n_changed", "n_numeric", status.alias("status"), stale.alias("stale"))


def update_accuracy(cells: DataFrame, source_values: DataFrame, keys: list[str]) -> DataFrame:
    """Changed non-zero numbers that occur among the source's numbers.  ``cells`` as in :func:`table_changes`."""
    changed = cells.where((F.col("before") != F.col("after")) & (F.coalesce("after_num", F.lit(0)) != 0))
    known = source_values.select(*keys, "value").distinct().withColumn("known", F.lit(True))
    j = changed.withColumn("value", F.col("after_num")).join(known, [*keys, "value"], "left")
    g = j.groupBy(*keys).agg(F.count_if(F.coalesce("known", F.lit(False))).alias("n_correct"), F.count("*").alias("n"))
    return g.select(*keys, "n_correct", (F.col("n") - F.col("n_correct")).alias("n_wrong"), (F.col("n_correct").cast("double") / F.col("n").cast("double")).alias("accuracy"))
