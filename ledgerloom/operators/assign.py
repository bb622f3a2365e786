"""One-to-one assignment: left items in order, each takes its best unused right item.

Who is served next depends on all that were served before, so a group is worked off in order by one task. It reads the group as a sorted stream and keeps only what is used up: time and memory grow
linearly with a group, no group is gathered, and the number of jobs is fixed whatever the preferences. Different groups run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _plain(column: pa.Array) -> list:
    """Values that can be hashed."""
    values = column.to_pylist()
    return [tuple(v.values()) if v is not None else None for v in values] if pa.types.is_struct(column.type) else values


def greedy(edges: DataFrame, group: list[str]) -> DataFrame:
    """Assign within each group; returns ``group + [l, r, s, o]``.

    ``edges`` holds ``group``, the left key ``l`` (its order is the order of service), the right key ``r``, the score ``s`` and the tie order ``o``.
    """
    edges = edges.select(*group, "l", "r", F.col("s").cast("double").alias("s"), "o")
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, served, used = None, None, set()
        for b in batches:
            picked = []
            groups = zip(*[_plain(b.column(k)) for k in range(n)])
            for i, (g, left, right) in enumerate(zip(groups, _plain(b.column(n)), _plain(b.column(n + 1)))):
                if g != here:
                    here, served, used = g, None, set()
                if served != (left,) and right not in used:
                    served = (left,)
                    used.add(right)
                    picked.append(i)
            if picked:
                yield b.take(pa.array(picked))

    ordered = edges.repartition(*group).sortWithinPartitions(*group, "l", F.desc("s"), "o", "r")
    return ordered.mapInArrow(run, edges.schema)


def first_free(left: DataFrame, right: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Each left item in order takes the smallest unused right item of its group that shares any of its values; returns ``group + [l, r]``.

    ``left``: group, l, values; ``right``: group, r, values; an item has a row for each of its values (equal in all columns ``values``). Items of one value are queued, never paired, so
    a value that many items of both sides hold costs no more than another.
    """
    value = F.struct(*values)
    sides = [df.select(*group, F.lit(side).alias("side"), F.col(item).alias("item"), value.alias("v")) for side, df, item in ((0, right, "r"), (1, left, "l"))]
    items = reduce(DataFrame.unionByName, sides).groupBy(*group, "side", "item").agg(F.collect_set("v").alias("v"))
    n = len(group)
    out = StructType([*(left.schema[g] for g in group), StructField("l", left.schema["l"].dataType), StructField("r", right.schema["r"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used, queues, first = None, set(), {}, {}
        for b in batches:
            picked, taken = [], []
            groups = zip(*[_plain(b.column(k)) for k in range(n)])
            for i, (g, side, item, held) in enumerate(zip(groups, b.column(n).to_pylist(), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist())):
                if g != here:
                    here, used, queues, first = g, set(), {}, {}
                best = None
                for v in map(tuple, map(dict.values, held)):
                    if side == 0:
                        queues.setdefault(v, []).append(item)
                        continue
                    queue, k = queues.get(v, ()), first.get(v, 0)
                    while k < len(queue) and queue[k] in used:
                        k += 1
                    first[v] = k
                    if k < len(queue) and (best is None or queue[k] < best):
                        best = queue[k]
                if best is not None:
                    used.add(best)
                    picked.append(i)
                    taken.append(best)
            if picked:
                at = pa.array(picked)
                columns = [b.column(k).take(at) for k in (*range(n), n + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(taken, b.column(n + 1).type)], names=out.names)

    ordered = items.repartition(*group).sortWithinPartitions(*group, "side", "item")
    return ordered.mapInArrow(run, out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
