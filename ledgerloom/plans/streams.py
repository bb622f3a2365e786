"""Queries that run a stream over the job events and read what it left.

The events are written in slices of time, one after another, and a stream reads them file by file; a last far event lets the watermark pass all others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.jobs import SHOWN, STATE
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_dir
from ledgerloom.streaming import keyed, lifecycle

SLICES = 3
FAR = -1
DELAY = "1 hour"
#: The derived jobs (users) go on over the whole time, so an ended one is remembered for longer than that.
KEEP_MS = 100 * 366 * 86_400_000


def fed(rows: DataFrame, at: str, key: str, folder: str) -> DataFrame:
    """``rows`` as a stream of about three micro-batches in a session of its own, whose states have as many partitions as the cluster has cores."""
    spark = rows.sparkSession
    bounds = rows.agg(F.min(F.unix_micros(at)).alias("a"), F.max(F.unix_micros(at)).alias("b")).first()
    if bounds.a is None:
        rows.write.mode("append").parquet(folder)
    else:
        step = (bounds.b - bounds.a) // SLICES + 1
        slices = rows.withColumn("slice", F.floor((F.unix_micros(at) - bounds.a) / step))
        for k in range(SLICES):
            slices.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(folder)
        far = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns} | {key: F.lit(FAR).cast("bigint"), at: F.timestamp_micros(F.lit(bounds.b + 30 * 86_400_000_000))}
        if "event_id" in rows.columns:
            far["event_id"] = F.lit(FAR).cast("bigint")
        spark.range(1).select(*[far[c].alias(c) for c in rows.columns]).write.mode("append").parquet(folder)
    own = spark.newSession()
    own.conf.set(*lifecycle.STORE)
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    return own.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // SLICES)).parquet(folder)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _replayed(rows: DataFrame, stream) -> DataFrame:
    folder = _folder(rows.sparkSession)
    out = stream(fed(rows, "ts", "job_id", f"{folder}/in"), DELAY, KEEP_MS)
    done = out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    done.awaitTermination()
    return rows.sparkSession.read.schema(out.schema).parquet(f"{folder}/out").where(F.col("job_id") != FAR)


ORDER = "CAST(epoch_us(ts) AS HUGEINT) * 10000000000 + event_id"


@query("t05_stream_until_terminal", ["job_events"], f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, job_id, type, progress, message FROM (
 SELECT *, MIN(CASE WHEN type IN ('complete', 'error') THEN {ORDER} END) OVER (PARTITION BY job_id) AS stop FROM job_events) e WHERE stop IS NULL OR {ORDER} <= stop""")
def _t05_stream(ev):
    out = _replayed(ev.withColumn("ts", F.col("ts").cast("timestamp")), lifecycle.until_terminal_stream)
    return out.select("event_id", SHOWN("ts").alias("ts"), "job_id", "type", "progress", "message")


#: A job's first event queues it, a second starts it; what follows asks for an end now and then.
WANTED = "CASE type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' ELSE CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'queued' ELSE CASE WHEN event_id % 28 = 3 THEN 'cancelled' ELSE 'processing' END END END"
LIFE = f"""
WITH RECURSIVE o AS (SELECT job_id, event_id, ts, {WANTED} AS status, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM job_events),
 r AS (SELECT job_id, event_id, k, status, CAST(NULL AS VARCHAR) AS before, status = 'queued' AS allowed, CASE WHEN status = 'queued' THEN status END AS after FROM o WHERE k = 1
  UNION ALL SELECT o.job_id, o.event_id, o.k, o.status, r.after, n.ok, CASE WHEN n.ok THEN o.status ELSE r.after END
  FROM r JOIN o ON o.job_id = r.job_id AND o.k = r.k + 1,
   LATERAL (SELECT COALESCE((r.after IS NULL AND o.status = 'queued') OR (r.after = 'queued' AND o.status IN ('processing', 'failed')) OR (r.after = 'processing' AND o.status IN ('completed', 'failed', 'cancelled')), FALSE) AS ok) n
  WHERE r.after IS NULL OR r.after NOT IN ('completed', 'failed', 'cancelled'))
SELECT job_id, event_id, status, before, allowed FROM r"""


def _life_rows(ev: DataFrame) -> DataFrame:
    return ev.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(WANTED).alias("status"))


@query("t06_lifecycle", ["job_events"], LIFE)
def _t06_batch(ev):
    return lifecycle.lifecycle(_life_rows(ev)).select("job_id", "event_id", "status", "before", "allowed")


@query("t06_stream_lifecycle", ["job_events"], LIFE)
def _t06_stream(ev):
    return _replayed(_life_rows(ev), lifecycle.lifecycle_stream).select("job_id", "event_id", "status", "before", "allowed")


@query("t08_stream_retention", ["jobs"], """
SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, status FROM jobs WHERE created_at >= (SELECT MAX(created_at) FROM jobs) - INTERVAL 24 HOUR""")
def _t08_stream(jobs):
    spark, folder = jobs.sparkSession, _folder(jobs.sparkSession)
    rows = jobs.select("job_id", F.col("created_at").cast("timestamp").alias("created_at"), "status")
    rows = rows.unionByName(rows.where("job_id % 3 = 0"))
    table = keyed.KeyedTable(f"{folder}/jobs", "job_id", {"created_at": "timestamp", "status": "string"}).create(spark)
    stream = fed(rows, "created_at", "job_id", f"{folder}/in").where(F.col("job_id") != FAR)
    keyed.retention_stream(stream, table, f"{folder}/checkpoint").awaitTermination()
    return table.read(spark).withColumn("created_at", SHOWN("created_at"))


@query("t09_stream_upsert", ["jobs", "job_events"], """
WITH u AS (SELECT job_id, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status, arg_max(progress, event_id) FILTER (progress IS NOT NULL) AS progress FROM (SELECT job_id, event_id, progress, CASE type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' END AS status FROM job_events) q GROUP BY job_id)
SELECT COALESCE(j.job_id, u.job_id) AS job_id, COALESCE(u.status, j.status) AS status, COALESCE(u.progress, j.progress) AS progress FROM (SELECT job_id, status, CAST(0 AS BIGINT) AS progress FROM jobs) j FULL OUTER JOIN u ON u.job_id = j.job_id""")
def _t09_stream(jobs, ev):
    spark, folder = jobs.sparkSession, _folder(jobs.sparkSession)
    table = keyed.KeyedTable(f"{folder}/jobs", "job_id", {"status": "string", "progress": "bigint"}).create(spark)
    table.apply(jobs.select("job_id", "status", F.lit(0).alias("progress"), F.lit(-1).alias("event_id")), -1, "event_id")
    ended = F.when(F.col("type") == "complete", "completed").when(F.col("type") == "error", "failed")
    stream = fed(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "job_id", f"{folder}/in").where(F.col("job_id") != FAR)
    keyed.upsert_stream(stream.select("job_id", "event_id", ended.alias("status"), "progress"), table, "event_id", f"{folder}/checkpoint").awaitTermination()
    return table.read(spark)
