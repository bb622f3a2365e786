"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import durable

__all__ = ["durable", "held_out", "numbered", "spread", "unused"]


def held_out(key: Column) -> Column:
    """Rows that no classifier learns from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row, so that repeated ids stay apart; the result must be made durable before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def spread(df: DataFrame, n: int) -> Column:
    """A group from 0 to n - 1 by place in the input, so that no value can crowd a group."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` (in whatever case) and none before it has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
