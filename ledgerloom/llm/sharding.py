"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import durable

CELL_ROWS = 256
_SLOT_BITS = 12


def _position(h: Column) -> Column:
    """A place on the ring from 0 to 2**52 - 1."""
    return F.shiftrightunsigned(h, 12)


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """(arc, point, prefs) for each of the shards x points virtual nodes, in ring order.

    An arc ends at its point; prefs lists all shards in the order in which their points follow clockwise.
    """
    everything = Window.partitionBy(F.lit(0))
    nodes = spark.range(shards * points).select(F.floor(F.col("id") / points).cast("int").alias("shard"), F.pmod("id", F.lit(points)).alias("number"))
    nodes = nodes.select("shard", _position(F.xxhash64(F.lit("node"), "shard", "number")).alias("point"))
    nodes = nodes.withColumn("arc", F.row_number().over(everything.orderBy("point", "shard")) - 1)
    nodes = nodes.withColumn("owners", F.sort_array(F.collect_list(F.struct("arc", "shard")).over(everything)))
    clockwise = F.concat(F.slice("owners", F.col("arc") + 1, F.lit(shards * points)), F.slice("owners", F.lit(1), F.col("arc")))
    return nodes.select("arc", "point", F.array_distinct(F.transform(clockwise, lambda x: x["shard"])).alias("prefs"))


def _lookup(arcs: DataFrame) -> DataFrame:
    """(slot, near): for each of 2**12 equal stretches of the ring the arcs that end in it and the one after; at most
    a few entries, and as many rows whatever the data's size."""
    spark = arcs.sparkSession
    slot = F.shiftright("point", 52 - _SLOT_BITS)
    held = arcs.groupBy(slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct("point", "arc"))).alias("own"))
    after = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    closing = F.struct(F.lit(1 << 52).alias("point"), F.lit(0).alias("arc"))
    slots = spark.range(1 << _SLOT_BITS).withColumnRenamed("id", "slot").join(held, "slot", "left")
    behind = F.coalesce(F.first(F.col("own")[0], ignorenulls=True).over(after), closing)
    return slots.select("slot", F.concat(F.coalesce("own", F.array().cast("array<struct<point:bigint,arc:int>>")), F.array(behind)).alias("near"))


def _admit(arcs: DataFrame, shards: int, total: Column) -> DataFrame:
    """(arc, stays): how an arc's rows, by rank, are dealt to shards: array of (upto, shard, base, hops).

    Ranks below ``upto`` (and not below the entry before) go to ``shard``; the first of them gets slot ``base``.
    """
    everything = Window.partitionBy(F.lit(0))
    capacity = F.floor(total / shards).cast("long") + F.when(F.col("target") < F.pmod(total, F.lit(shards)), 1).otherwise(0)
    state = arcs.withColumn("loads", F.array_repeat(F.lit(0).cast("long"), shards)).withColumn("rest", F.col("n")).withColumn("done", F.lit(0).cast("long"))
    stays = []
    for r in range(shards):
        state = state.withColumn("target", F.element_at("prefs", r + 1))
        own = Window.partitionBy("target").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("rest").over(own), F.lit(0))
        state = state.withColumn("before", before).withColumn("load", F.element_at("loads", F.col("target") + 1))
        state = state.withColumn("take", F.greatest(F.lit(0).cast("long"), F.least("rest", capacity - F.col("load") - F.col("before"))))
        state = state.withColumn("taken", F.collect_list(F.struct("target", "take")).over(everything))
        summed = lambda s: F.aggregate("taken", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["target"] == s, x["take"]).otherwise(0))
        stay = F.struct((F.col("done") + F.col("take")).alias("upto"), F.col("target").alias("shard"), (F.col("load") + F.col("before")).alias("base"), F.lit(r).alias("hops"), F.col("done").alias("start"))
        state = state.withColumn(f"s{r}", stay).withColumn("loads", F.transform("loads", lambda x, s: x + summed(s)))
        state = state.withColumn("done", F.col("done") + F.col("take")).withColumn("rest", F.col("rest") - F.col("take")).drop("taken")
        stays.append(f"s{r}")
    return state.select("arc", F.filter(F.array(*stays), lambda s: s["upto"] > s["start"]).alias("stays"))


def bounded_ring(rows: DataFrame, key: str, ties: list[str], shards: int = 8, points: int = 128) -> DataFrame:
    """``rows`` with shard, slot, home (the ring's own choice) and hops (full shards passed by).

    A row's place is the hash of its key; the next point clockwise owns it. The shards' capacities sum to the number of rows and differ
    by one at most, so the counts do too. Keys that find their shard full go on clockwise to the next
    one. Admission is settled by arcs: in round r each shard takes what the arcs that have it as r-th choice still hold, in ring order,
    until it is full (as much as a round needs is known from counts per arc, a table of shards x points rows). A row finds its shard by
    its rank within its arc; ranks are counted in cells of about ``CELL_ROWS`` rows, so no arc or shard is sorted in one task,
    and a cell crowded by one key is split by place. slot numbers a shard's rows from 0 without gaps.

    Null keys are hashed like a value. Rows equal in key and ties are interchangeable; each gets its own slot. An empty table gives
    no rows. ``rows`` must not have columns that begin with an underscore.
    """
    spark = rows.sparkSession
    arcs = durable(ring(spark, shards, points))
    at = _position(F.xxhash64(F.lit("key"), F.col(key)))
    placed = rows.withColumn("_at", at).withColumn("_slot", F.shiftright("_at", 52 - _SLOT_BITS).cast("long"))
    near = F.broadcast(_lookup(arcs).select(F.col("slot").alias("_slot"), "near"))  # 2**12 short rows at any size
    placed = placed.join(near, "_slot").withColumn("_arc", F.element_at(F.filter("near", lambda p: p["point"] >= F.col("_at")), 1)["arc"]).drop("near", "_slot")
    placed = durable(placed)
    total = placed.count()
    cells = max(1, total // (shards * points * CELL_ROWS))
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("_at", *ties), F.lit(cells)).cast("int")).withColumn("_place", F.monotonically_increasing_id())
    crowded = placed.groupBy("_arc", "_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > 64 * CELL_ROWS).select("_arc", "_cell", F.ceil(F.col("_n") / CELL_ROWS).alias("_parts"))
    placed = durable(placed.join(crowded, ["_arc", "_cell"], "left").withColumn("_part", F.coalesce(F.pmod("_place", F.col("_parts")), F.lit(0))).drop("_parts", "_place"))
    group = ["_arc", "_cell", "_part"]
    counts = durable(placed.groupBy(*group).agg(F.count("*").alias("n")))
    ahead = Window.partitionBy("_arc").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    held = arcs.join(counts.groupBy(F.col("_arc").alias("arc")).agg(F.sum("n").alias("n")), "arc", "left").fillna({"n": 0})
    stays = durable(_admit(held, shards, F.lit(total).cast("long")).join(arcs.select("arc", F.col("prefs")[0].alias("home")), "arc"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_at", key, *ties)) - 1
    ranked = placed.withColumn("_inside", inside).join(offsets, group).withColumn("_rank", F.col("_before") + F.col("_inside"))
    ranked = ranked.join(F.broadcast(stays.withColumnRenamed("arc", "_arc")), "_arc")  # shards x points rows
    stay = F.element_at(F.filter("stays", lambda s: F.col("_rank") < s["upto"]), 1)
    ranked = ranked.withColumn("_stay", stay)
    return ranked.select(*rows.columns, F.col("_stay.shard").alias("shard"), (F.col("_stay.base") + F.col("_rank") - F.col("_stay.start")).alias("slot"), "home", F.col("_stay.hops").alias("hops"))
