"""A small keyed table kept by a stream: partial updates, retention, and batches that may come twice.

Per key and column the value of the highest order wins, so late updates never undo newer ones and the outcome does not depend on how rows are dealt over batches. Each batch writes the whole table into
the spare one of two folders and then appends one row to a commit table, which is what readers go by: a batch that failed half-way is invisible, and one that was committed
is not applied again. Meant for tables that retention keeps small, such as the jobs of the last days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_COMMITS = "batch_id bigint, slot int"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``columns`` (SQL types by name) by ``key``; ``order`` is a whole number that rises with time."""

    path: str
    key: str
    columns: dict[str, str]

    def _schema(self) -> str:
        return ", ".join([f"`{self.key}` bigint", *(f"`{c}` struct<at: bigint, value: {t}>" for c, t in self.columns.items())])

    def create(self, spark: SparkSession) -> KeyedTable:
        spark.createDataFrame([], _COMMITS).write.mode("ignore").parquet(f"{self.path}/commits")
        return self

    def _committed(self, spark: SparkSession) -> tuple[int, int] | None:
        last = spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").agg(F.max(F.struct("batch_id", "slot")).alias("m")).first()["m"]
        return None if last is None else (last["batch_id"], last["slot"])

    def _stored(self, spark: SparkSession, last: tuple[int, int] | None) -> DataFrame:
        if last is None:
            return spark.createDataFrame([], self._schema())
        return spark.read.schema(self._schema()).parquet(f"{self.path}/slot{last[1]}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of the last committed batch."""
        return self._stored(spark, self._committed(spark)).select(self.key, *[F.col(c)["value"].alias(c) for c in self.columns])

    def merged(self, stored: DataFrame, updates: DataFrame, order: str) -> DataFrame:
        """Per column the value of the highest order; a null value is no update. Added up map-side, so a busy key is no hot spot."""
        given = [F.when(F.col(c).isNotNull(), F.struct(F.col(order).cast("bigint").alias("at"), F.col(c).cast(t).alias("value"))).alias(c) for c, t in self.columns.items()]
        rows = stored.unionByName(updates.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("bigint").alias(self.key), *given))
        return rows.groupBy(self.key).agg(*[F.max(c).alias(c) for c in self.columns])

    def apply(self, updates: DataFrame, batch_id: int, order: str, retained: Column | None = None) -> bool:
        """Commit ``updates`` as batch ``batch_id``; False if that batch or a later one is committed already. ``retained`` (over plain columns) says which rows stay."""
        spark = updates.sparkSession
        last = self._committed(spark)
        if last is not None and batch_id <= last[0]:
            return False
        rows = self.merged(self._stored(spark, last), updates, order)
        if retained is not None:
            plain = rows.select(F.struct("*").alias("all"), *[F.col(c)["value"].alias(c) for c in self.columns])
            rows = plain.where(retained).select("all.*")
        slot = 0 if last is None else 1 - last[1]
        rows.write.mode("overwrite").parquet(f"{self.path}/slot{slot}")
        spark.createDataFrame([(batch_id, slot)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True


def upsert_stream(updates: DataFrame, table: KeyedTable, order: str, checkpoint: str) -> StreamingQuery:
    """Start applying a stream of partial updates to ``table``, a committed generation a micro-batch."""
    return updates.writeStream.foreachBatch(lambda rows, batch_id: table.apply(rows, batch_id, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_recent(jobs: DataFrame, retention: str = "24 hours") -> DataFrame:
    """A stream of jobs (job_id, created_at) without those older than the retention time and without repeats; state is kept for the retention time only."""
    return jobs.withWatermark("created_at", retention).dropDuplicatesWithinWatermark(["job_id"])


def retention_stream(jobs: DataFrame, table: KeyedTable, checkpoint: str, retention: str = "24 hours") -> StreamingQuery:
    """Start keeping in ``table`` (with created_at) the jobs created within ``retention`` of the newest one seen."""

    def step(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        newest = rows.agg(F.max("created_at")).first()[0]
        stored = table.read(rows.sparkSession).agg(F.max("created_at")).first()[0]
        newest = max((t for t in (newest, stored) if t is not None), default=None)
        old = None if newest is None else F.col("created_at") >= F.lit(newest) - F.expr(f"INTERVAL {retention}")
        table.apply(rows.withColumn("seen", F.unix_micros("created_at")), batch_id, "seen", old)
        rows.unpersist()

    return distinct_recent(jobs, retention).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
