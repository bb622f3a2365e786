"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import durable


def _led(rows: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its root in ``up``; what ``up`` doesn't hold stays."""
    return rows.join(up.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``links`` (a, b) to (node, root): root is the smallest node reachable.

    Each round every node follows the neighbour of the smallest hash, and then that one's own choice; nodes that meet are
    merged, and links between merged nodes leave the work. As the order is by hash, a fixed share of the nodes is expected
    to go in each round, whatever the paths, and each round works on a smaller table. Nothing is collected.

    With ``rounds`` it stops early: nodes of one root are then surely linked, but linked nodes may have different roots,
    and a root is some node of its class.
    """
    links = links.where("a <> b").select("a", "b")
    edges = durable(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found, done = None, 0
    while rounds is None or done < rounds:
        best = edges.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("b")).alias("root"))
        up = best.withColumn("root", F.when(F.xxhash64("root") < F.xxhash64("node"), F.col("root")).otherwise(F.col("node")))
        up = durable(_led(up, up, "root"))
        found = up if found is None else _led(found, up, "root")
        done += 1
        if done == rounds:
            return found
        edges = durable(_led(_led(edges, up, "a"), up, "b").where("a <> b").distinct())
        if edges.isEmpty():
            break
    found = durable(found)
    return found.join(found.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root"))
