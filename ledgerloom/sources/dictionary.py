"""Bilingual dictionaries: markdown tables and arrow lines into (ko, en, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file, one entry per line; later entries of a term win."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    return parse_dictionary(lines)


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """Entries of ``value`` lines such as ``| ko | en |`` or ``ko → en``; heads and rulers are skipped."""
    v = F.trim("value")
    cells = F.filter(F.transform(F.split(v, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    table = v.contains("|") & ~v.contains("→") & ~v.contains("한국어") & ~v.contains("---")
    arrow = F.split(v, " → ", 2)
    ko = F.when(table & (F.size(cells) >= 2), F.get(cells, 0)).when(v.contains(" → ") & ~v.contains("|"), F.trim(F.get(arrow, 0)))
    en = F.when(table & (F.size(cells) >= 2), F.get(cells, 1)).when(v.contains(" → ") & ~v.contains("|"), F.trim(F.get(arrow, 1)))
    e = lines.select(ko.alias("ko"), en.alias("en"), "ord").where("ko is not null and ko <> '' and en <> ''")
    return e.groupBy("ko").agg(F.max_by("en", "ord").alias("en"), F.min("ord").alias("ord"))
