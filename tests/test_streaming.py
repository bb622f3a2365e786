"""Streams over files give what the batch forms give."""

from pyspark.sql import functions as F

from ledgerloom.plans.views import open_views
from ledgerloom.streaming import jobs as jb

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts timestamp, job_id bigint, type string, progress bigint, message string"


def events(spark, folder):
    ev = open_views(spark, SF, ["job_events"])[0].withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.mode("overwrite").parquet(folder)
    return ev, spark.readStream.schema(SCHEMA).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_latest_state_and_throttle(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "ev"))
    run(jb.latest_state(stream), "complete", "latest")
    assert rows(spark.table("latest")) == rows(jb.latest_state(batch))
    run(jb.throttled(stream.withWatermark("ts", "1 minute")), "complete", "throttle")
    assert rows(spark.table("throttle")) == rows(jb.throttled(batch))


def test_sessions(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "ev"))
    run(jb.active_sessions(stream.withWatermark("ts", "1 minute"), "12 hours"), "complete", "sessions")
    assert rows(spark.table("sessions")) == rows(jb.active_sessions(batch, "12 hours"))


def test_append_log(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "ev"))
    jb.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "log"))) == rows(jb.log_entries(batch))
