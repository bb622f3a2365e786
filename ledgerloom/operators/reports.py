"""Searches, markers, statement detection and document profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pattern families that tell a statement's type
TYPE_PATTERNS = {
    "BS": [r"자\s*산", r"부\s*채", "재무상태표", "유동자산", "비유동자산"],
    "IS": [r"매\s*출\s*액", "매출원가", "영업이익", "포괄손익", "손익계산서", "당기순이익", "영업수익"],
    "CE": ["자본금", "자본잉여금", "이익잉여금", "자본변동", r"전기초\s*잔액", r"당기초\s*잔액", r"기초\s*잔액"],
    "CF": ["영업활동.*현금", "투자활동.*현금", "재무활동.*현금", "현금흐름", "현금및현금성자산"],
}
EQUITY_HEADER = "자본금.*자본잉여금|자본잉여금.*이익잉여금"
MARKER = r"(?i)\[NEEDS_TRANSLATION:"
SPACER_WIDTH = 200


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def search(texts: DataFrame, query: str, by: str, order: list[str], limit: int = 20) -> DataFrame:
    """Texts holding ``query``: the first ``limit`` per collection, with the collection's total."""
    hits = texts.where(F.col("text").contains(query))
    total = hits.groupBy(by).agg(F.count("*").alias("total"))
    w = Window.partitionBy(by).orderBy(*order)
    top = hits.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= limit)
    at = F.locate(query, F.col("text"))
    return top.join(total, by).select(by, *order, "place", "total", at.cast("bigint").alias("found_at"))


def open_markers(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts that still carry an untranslated marker: critical findings."""
    return texts.where(F.col("text").rlike(MARKER)).select(*keys, F.lit("CRITICAL").alias("severity"), F.left("text", F.lit(100)).alias("excerpt"))


def header_years(headers: DataFrame) -> DataFrame:
    """Headers without the current (WARNING) or prior (INFO) year.  ``headers``: doc_id, header, period_current, period_prior."""
    checks = F.explode(F.array(F.struct(F.lit("WARNING").alias("severity"), F.col("period_current").alias("expected")),
                               F.struct(F.lit("INFO").alias("severity"), F.col("period_prior").alias("expected"))))
    x = headers.where("period_current <> ''").select("doc_id", "header", checks.alias("x"))
    return x.where((F.col("x.expected") != "") & ~F.col("header").contains(F.col("x.expected"))).select("doc_id", "x.severity", "x.expected")


def statement_scores(text: Column, header: Column) -> dict[str, Column]:
    """Pattern hits per statement type; an equity-like header row adds three for CE."""
    out = {}
    for code, patterns in TYPE_PATTERNS.items():
        out[code] = reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])
    out["CE"] = out["CE"] + F.when(header.rlike(EQUITY_HEADER), 3).otherwise(0)
    return out


def detect_statement(df: DataFrame, text: str, header: str) -> DataFrame:
    """Add ``stmt_type`` by score; the first of equals, BS when nothing hits."""
    s = statement_scores(F.col(text), F.col(header))
    names = {f"_{c}": col for c, col in s.items()}
    df = df.withColumns(names)
    top = F.greatest(*names)
    pick = F.when(top == 0, "BS")
    for c in TYPE_PATTERNS:
        pick = pick.when(F.col(f"_{c}") == top, c)
    return df.withColumn("stmt_type", pick).drop(*names)


def distinct_types(tables: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Statement types made unique: a type already taken falls to the next free one.

    After four tables every type is taken and later ones keep theirs, so only
    the first four of a document are folded.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    first = tables.withColumn("_k", F.row_number().over(w)).where("_k <= 4")
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "stmt_type"))).alias("t"))
    all_types = F.array(*[F.lit(c) for c in TYPE_PATTERNS])
    taken = F.aggregate("t", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(
        F.when(F.array_contains(acc, x["stmt_type"]), F.get(F.array_except(all_types, acc), 0)).otherwise(x["stmt_type"]))))
    got = lists.select(*keys, F.posexplode(taken).alias("p", "given")).withColumn("_k", F.col("p") + 1).drop("p")
    fixed = first.join(got, [*keys, "_k"]).select(*keys, order, "given")
    return tables.join(fixed, [*keys, order], "left").withColumn("final_type", F.coalesce("given", "stmt_type")).drop("given")


def find_statement_tables(cells: DataFrame, keys: list[str], table: str, min_rows: int = 10, equity_rows: int = 8) -> DataFrame:
    """The statement tables of a template: the first table per type by its wording.

    ``cells``: keys, table, row_idx, text.
    """
    has = lambda *words: F.max(_any([F.col("text").contains(w) for w in words]))
    top = F.col("row_idx") < 3
    head = lambda *words: F.max(top & _any([F.col("text").contains(w) for w in words]))
    t = cells.groupBy(*keys, table).agg(
        F.count_distinct("row_idx").alias("n"), (has("Total assets") & has("Total liabilities")).alias("has_bs"),
        (has("Revenue", "Operating profit") & has("Profit for the year") & ~F.max((F.col("row_idx") == 0) & F.col("text").contains("Share capital"))).alias("has_is"),
        has("Cash flows from operating").alias("has_cf"), (head("Share capital", "Capital surplus") & head("Retained earnings", "Treasury")).alias("has_ce"))
    big = F.col("n") >= min_rows
    first = lambda cond: F.min(F.when(cond, F.col(table)))
    g = t.groupBy(*keys).agg(first(big & F.col("has_bs")).alias("BS"), first(F.col("has_ce") & (F.col("n") >= equity_rows)).alias("CE"))
    t = t.join(g, keys)
    i = t.groupBy(*keys).agg(first(big & F.col("has_is") & ~F.col(table).eqNullSafe(F.col("BS"))).alias("IS"))
    t = t.join(i, keys)
    c = t.groupBy(*keys).agg(first(big & F.col("has_cf") & ~F.col(table).eqNullSafe(F.col("BS")) & ~F.col(table).eqNullSafe(F.col("IS"))).alias("CF"))
    w = g.join(i, keys).join(c, keys)
    kinds = F.array(*[F.struct(F.lit(k).alias("stmt_type"), F.col(k).cast("bigint").alias("table_seq")) for k in TYPE_PATTERNS])
    return w.select(*keys, F.explode(kinds).alias("x")).where("x.table_seq is not null").select(*keys, "x.stmt_type", "x.table_seq")


def style_profile(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Most used style, title, subtitle and body style of a document; the first seen of equals."""
    n = lines.groupBy(*keys, "style").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    rank = F.struct(F.col("n"), -F.col("s"))
    named = lambda *names: F.coalesce(*[F.max(F.when(F.col("style") == x, F.col("style"))) for x in names])
    other = ~F.col("style").isin("ABCTitle", "Subtitle", "aff5", "_Index", "_Index - Page(s)")
    return n.groupBy(*keys).agg(F.max_by("style", rank).alias("primary_style"), named("ABCTitle").alias("title_style"), named("Subtitle", "aff5").alias("subtitle_style"),
                                F.max_by("style", F.when(other, rank)).alias("body_style"))


def table_profile(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Spacing, merge and width habits of a document.  ``tables``: keys, n_spacers, n_widths, empty_row2, n_vmerge, n_gridspan."""
    share = lambda c: F.avg(c.cast("double"))
    g = tables.groupBy(*keys).agg(share(F.col("n_spacers") > 0).alias("sp"), share(F.col("empty_row2")).alias("er"), share(F.col("n_widths") > 0).alias("wd"),
                                  F.sum("n_vmerge").alias("vm"), F.sum("n_gridspan").alias("gs"), F.count("*").alias("n_tables"))
    spacing = (F.when(F.col("sp") > 0.3, "spacer_column").when(F.col("er") > 0.2, "empty_row").when((F.col("sp") > 0.1) & (F.col("er") > 0.1), "mixed").otherwise("none"))
    merge = (F.when(F.col("vm") + F.col("gs") == 0, "minimal").when(F.col("vm") > F.col("gs") * 2, "vmerge_heavy").when(F.col("gs") > F.col("vm") * 2, "gridspan_heavy").otherwise("balanced"))
    width = F.when(F.col("wd") > 0.8, "fixed").when(F.col("wd") < 0.2, "auto").otherwise("mixed")
    return g.select(*keys, "n_tables", spacing.alias("spacing"), merge.alias("merges"), width.alias("widths"), (F.col("er") > 0.2).alias("empty_row_pattern"))
