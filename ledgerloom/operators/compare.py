"""Value comparison of tables that belong together, and where else a table may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.assign import greedy
from ledgerloom.session import once

# Words that name a statement in a table title or header
STATEMENT_WORDS = {
    "BS": ["balance sheet", "financial position", "statement of financial position"],
    "IS": ["income", "comprehensive income", "profit or loss", "statement of comprehensive income"],
    "CE": ["changes in equity", "equity"],
    "CF": ["cash flow", "cash flows"],
}


def find_statement_tables(wanted: DataFrame, statements: DataFrame, titled: DataFrame) -> DataFrame:
    """A table per wanted statement: by its type, else the first one with a telling title.

    ``wanted``: pair_id, stmt_type; ``statements``: pair_id, stmt_type, table_seq;
    ``titled``: pair_id, table_seq, title.
    """
    direct = statements.groupBy("pair_id", "stmt_type").agg(F.min("table_seq").alias("by_type"))
    low = F.lower("title")
    kinds = [F.when(low.rlike("|".join(words)), F.lit(code)) for code, words in STATEMENT_WORDS.items()]
    named = titled.select("pair_id", "table_seq", F.explode(F.array_compact(F.array(*kinds))).alias("stmt_type")).groupBy(
        "pair_id", "stmt_type").agg(F.min("table_seq").alias("by_title"))
    j = wanted.join(direct, ["pair_id", "stmt_type"], "left").join(named, ["pair_id", "stmt_type"], "left")
    how = F.when(F.col("by_type").isNotNull(), "type").when(F.col("by_title").isNotNull(), "title").otherwise("none")
    return j.select("pair_id", "stmt_type", F.coalesce("by_type", "by_title").alias("table_seq"), how.alias("found_by"))


def compare_cells(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Every expected numeric cell with its counterpart: missing, mismatch or ok.

    Both: keys, row_idx, col_idx, value (NULL = not numeric, left out).
    """
    at = [*keys, "row_idx", "col_idx"]
    e = once(expected, "value").where("value is not null").withColumnRenamed("value", "expected")
    a = once(actual, "value").where("value is not null").withColumnRenamed("value", "found")
    j = e.join(a, at, "left")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.abs(F.col("expected") - F.col("found")) > tolerance, "mismatch").otherwise("ok")
    return j.select(*at, "expected", "found", verdict.alias("verdict"))


def cell_findings(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per table: missing WARNING, mismatch CRITICAL, INFO when all is well."""
    g = compared.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == "missing").alias("n_missing"),
        F.count_if(F.col("verdict") == "mismatch").alias("n_mismatch"),
        F.count("*").alias("n_cells"))
    level = F.when(F.col("n_mismatch") > 0, "CRITICAL").when(F.col("n_missing") > 0, "WARNING").otherwise("INFO")
    return g.withColumn("severity", level)


def first_numbers(cells: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """The non-zero numbers of each table; with ``limit`` only the first so many in reading order."""
    if limit is None:
        return cells.where("value <> 0")
    w = Window.partitionBy(*keys).orderBy("row_idx", "col_idx")
    return cells.where("value <> 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def match_by_number_share(left: DataFrame, right: DataFrame, sizes: DataFrame, limit: int | None = None, least: float = 0.3) -> DataFrame:
    """Tables by share of their numbers, row counts within max(10, half); one to one.

    ``left``: pair_id, l, row_idx, col_idx, value; ``right``: pair_id, r, ...;
    ``sizes``: pair_id, side, id, n_rows.
    """
    a = first_numbers(left, ["pair_id", "l"], limit).select("pair_id", "l", "value").distinct()
    b = first_numbers(right, ["pair_id", "r"], limit).select("pair_id", "r", "value").distinct()
    na = a.groupBy("pair_id", "l").agg(F.count("*").alias("na"))
    ls = sizes.where("side = 'l'").select("pair_id", F.col("id").alias("l"), F.col("n_rows").alias("rl"))
    rs = sizes.where("side = 'r'").select("pair_id", F.col("id").alias("r"), F.col("n_rows").alias("rr"))
    e = a.join(b, ["pair_id", "value"]).groupBy("pair_id", "l", "r").agg(F.count("*").alias("common"))
    e = e.join(na, ["pair_id", "l"]).join(ls, ["pair_id", "l"]).join(rs, ["pair_id", "r"])
    e = e.where(F.abs(F.col("rr") - F.col("rl")) <= F.greatest(F.lit(10.0), F.col("rl") * 0.5))
    e = e.withColumn("s", F.col("common").cast("double") / F.col("na").cast("double")).where(F.col("s") >= least)
    return greedy(e.select("pair_id", "l", "r", "s", F.col("r").alias("o")), ["pair_id"]).select(
        "pair_id", "l", "r", F.col("s").alias("score"))


def best_sample_match(left: DataFrame, right: DataFrame, sizes: DataFrame, tables: int | None = None, numbers: int | None = None, slack: int = 5) -> DataFrame:
    """Each table's numbers against all numbers of a table of about the same length; ``tables`` and ``numbers`` ask for a sample of the first ones."""
    if tables is not None:
        first = left.where("value <> 0").select("pair_id", "l").distinct().withColumn(
            "k", F.row_number().over(Window.partitionBy("pair_id").orderBy("l"))).where(F.col("k") <= tables)
        left = left.join(first.drop("k"), ["pair_id", "l"])
    a = first_numbers(left, ["pair_id", "l"], numbers)
    n = a.groupBy("pair_id", "l").agg(F.count("*").alias("n"))
    a = a.groupBy("pair_id", "l", "value").agg(F.count("*").alias("c"))
    b = right.where("value <> 0").select("pair_id", "r", "value").distinct()
    ls = sizes.where("side = 'l'").select("pair_id", F.col("id").alias("l"), F.col("n_rows").alias("rl"))
    rs = sizes.where("side = 'r'").select("pair_id", F.col("id").alias("r"), F.col("n_rows").alias("rr"))
    e = a.join(b, ["pair_id", "value"]).groupBy("pair_id", "l", "r").agg(F.sum("c").alias("c"))
    e = e.join(n, ["pair_id", "l"]).join(ls, ["pair_id", "l"]).join(rs, ["pair_id", "r"]).where(F.abs(F.col("rr") - F.col("rl")) <= slack)
    e = e.withColumn("score", F.col("c").cast("double") / F.col("n").cast("double"))
    best = e.groupBy("pair_id", "l").agg(F.min(F.struct((-F.col("score")).alias("ns"), F.col("r"))).alias("m")).select(
        "pair_id", "l", F.col("m.r").alias("r"), (-F.col("m.ns")).alias("score"))
    return n.select("pair_id", "l").join(best, ["pair_id", "l"], "left")
