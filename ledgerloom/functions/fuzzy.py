"""Gestalt string similarity, and candidates for it that lose no match."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.session import durable


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio ``2 M / (|a| + |b|)`` of trimmed texts, batch by batch."""
    return pd.Series([difflib.SequenceMatcher(None, x.strip(), y.strip()).ratio() for x, y in zip(a, b)])


def char_counts(c) -> Column:
    """Characters of a text numbered by occurrence: ``aab`` gives a1, a2, b1."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(
        chars,
        lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")),
    )


def fuzzy_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct texts (``a``, ``b``) that may reach ``threshold``.

    The ratio cannot exceed the shared share of counted characters, so a prefix
    of each text's rarest characters must meet: an equi-join on rare
    characters, then exact length and overlap bounds.
    """
    def with_chars(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.trim(F.col(name)).alias(name)).distinct().withColumn("chars", char_counts(F.col(name)))

    a, b = durable(with_chars(left, "a")), durable(with_chars(right, "b"))
    both = a.select(F.explode("chars").alias("ch")).unionByName(b.select(F.explode("chars").alias("ch")))
    freq = both.groupBy("ch").agg(F.count("*").alias("f"))
    ratio = threshold / (2.0 - threshold)

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, F.explode("chars").alias("ch")).join(freq, "ch").groupBy(name).agg(
            F.array_sort(F.collect_list(F.struct("f", "ch"))).alias("r")
        )
        size = F.size("r")
        keep = size - F.ceil(size * ratio - 1e-9) + 1
        return ranked.select(name, F.explode(F.slice("r", 1, F.greatest(keep, F.lit(1)).cast("int"))).alias("x")).select(
            name, F.col("x.ch").alias("ch")
        )

    met = prefix(a, "a").join(prefix(b, "b"), "ch").select("a", "b").distinct()
    la, lb = F.length("a"), F.length("b")
    near = met.where(2.0 * F.least(la, lb) >= (threshold - 1e-9) * (la + lb))
    near = near.join(a.withColumnRenamed("chars", "ca"), "a").join(b.withColumnRenamed("chars", "cb"), "b")
    shared = F.size(F.array_intersect("ca", "cb"))
    return near.where(2.0 * shared >= (threshold - 1e-9) * (la + lb)).select("a", "b")


def best_fuzzy(left: DataFrame, dictionary: DataFrame, threshold: float) -> DataFrame:
    """Best dictionary entry per text ``a`` with ratio >= threshold; the first of equals wins.

    ``dictionary``: ko, en, ord.  Returns a, ko, en, ratio.
    """
    cand = fuzzy_candidates(left, dictionary.select(F.col("ko").alias("b")), threshold)
    rated = cand.withColumn("ratio", sequence_ratio("a", "b")).where(F.col("ratio") >= threshold)
    entries = dictionary.select(F.trim("ko").alias("b"), "ko", "en", "ord")
    best = rated.join(entries, "b").groupBy("a").agg(
        F.min(F.struct((-F.col("ratio")).alias("nr"), F.col("ord"), F.col("ko"), F.col("en"))).alias("m")
    )
    return best.select("a", F.col("m.ko").alias("ko"), F.col("m.en").alias("en"), (-F.col("m.nr")).alias("ratio"))
