"""Job progress: the same expressions over a stream of events or over a table of them.

Events: event_id, ts, job_id, type (log|progress|complete|error), progress, message
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sequence import carry_last, row_position, running_sum

# Words in a message and the progress they stand for, in order
PROGRESS_WORDS = [
    (5, ["구조 분석", "로딩"]), (15, ["매칭"]), (25, ["재무상태표"]), (35, ["포괄손익"]), (45, ["자본변동"]), (55, ["현금흐름"]), (65, ["주석"]),
    (80, ["연도 롤링", "year"]), (90, ["검증", "validation"]), (95, ["완료", "저장"]),
]
TERMINAL = ["complete", "error"]
NEXT_STATES = {"queued": ["processing", "failed"], "processing": ["completed", "failed", "cancelled"]}
RESTART_ERROR = "still open when the service came up again"


def estimated_progress(message) -> Column:
    """Progress told by a log message; the first rule that hits, else NULL."""
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    out = None
    for value, words in PROGRESS_WORDS:
        hit = reduce(lambda a, b: a | b, [m.contains(w) for w in words])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.cast("bigint")


def with_progress(events: DataFrame) -> DataFrame:
    """Events with the estimate where they carry no progress of their own."""
    return events.withColumn("progress", F.coalesce("progress", estimated_progress("message")))


def latest_state(events: DataFrame) -> DataFrame:
    """Status, last known progress and current step per job."""
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    status = (F.when(F.max(F.col("type") == "complete"), "completed").when(F.max(F.col("type") == "error"), "failed").otherwise("processing"))
    return with_progress(events).groupBy("job_id").agg(
        status.alias("status"), last("progress").alias("progress"), F.left(last("message"), F.lit(100)).alias("current_step"), F.max("ts").alias("updated_at"))


def throttled(events: DataFrame, every: str = "5 seconds") -> DataFrame:
    """At most one persisted state per job and interval: the last of each window."""
    at = F.struct("ts", "event_id")
    w = with_progress(events).groupBy("job_id", F.window("ts", every).alias("w")).agg(
        F.max_by("progress", F.when(F.col("progress").isNotNull(), at)).alias("progress"), F.max_by("message", at).alias("message"), F.count("*").alias("n"))
    return w.select("job_id", F.col("w.start").alias("window_start"), "progress", "message", "n")


def active_sessions(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Stretches of a job without a silence of ``gap``; each end is where a ping was due."""
    w = events.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("job_id", F.col("w.start").alias("started"), F.col("w.end").alias("ping_due"), "n")


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and including the job's first terminal one; later ones are dropped. The stream form is in lifecycle.py."""
    at = F.struct("ts", "event_id")
    ends = events.where(F.col("type").isin(*TERMINAL)).groupBy("job_id").agg(F.min(at).alias("end"))
    return events.join(ends, "job_id", "left").where(F.col("end").isNull() | (at <= F.col("end"))).drop("end")


def transitions(states: DataFrame) -> DataFrame:
    """State changes of jobs with a flag for forbidden ones.  ``states``: job_id, event_id (rising), status."""
    t = carry_last(states, ["job_id"], "event_id", F.col("status"), "before", inclusive=False)
    allowed = [(F.col("before") == a) & F.col("status").isin(*b) for a, b in NEXT_STATES.items()]
    ok = F.col("before").isNull() | (F.col("before") == F.col("status")) | reduce(lambda a, b: a | b, allowed)
    return t.withColumn("allowed", ok)


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """After a restart, jobs that were still open have failed."""
    stale = F.col("status").isin("processing", "queued")
    return jobs.withColumns({"error": F.when(stale, RESTART_ERROR), "completed_at": F.when(stale, now).otherwise(F.col("completed_at")),
                             "status": F.when(stale, "failed").otherwise(F.col("status"))})


def drop_old(jobs: DataFrame, now: Column, retention: str = "24 hours") -> DataFrame:
    """Jobs created within the retention time."""
    return jobs.where(F.col("created_at") >= now - F.expr(f"INTERVAL {retention}"))


def upsert(current: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after partial updates: per column the latest given value, else the stored one; new keys are added."""
    cols = [c for c in current.columns if c != key]
    last = updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in cols])
    return current.join(last, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def log_entries(events: DataFrame) -> DataFrame:
    """Log rows as they are appended: results cut at 500 characters."""
    level = F.when(F.col("type") == "error", "error").when(F.col("type") == "complete", "success").otherwise("info")
    return events.select("event_id", "ts", "job_id", level.alias("level"), F.left("message", F.lit(500)).alias("message"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Start appending the log of a stream of events to ``path``."""
    return log_entries(events).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def memory_state(log: DataFrame) -> DataFrame:
    """Key-value memory from its change log: last write wins, deletions leave, long values are cut in the summary.

    ``log``: owner, key, seq, value (NULL deletes).
    """
    last = log.groupBy("owner", "key").agg(F.max_by("value", "seq").alias("value")).where("value is not null")
    shown = F.when(F.length("value") > 200, F.concat(F.left("value", F.lit(200)), F.lit("..."))).otherwise(F.col("value"))
    return last.withColumn("summary", F.concat(F.lit("- "), "key", F.lit(": "), shown))


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest jobs first."""
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def job_status(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Live state first, the stored row as fallback.  ``live``: job_id, status, progress."""
    j = jobs.join(live.select("job_id", F.col("status").alias("ls"), "progress"), "job_id", "left")
    return j.select("job_id", F.coalesce("ls", "status").alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"))


def repeated_actions(calls: DataFrame, keys: list[str], order: str, action: str, limit: int = 3) -> DataFrame:
    """Calls with ``skipped`` set on every ``limit``-th same action in a row (the count then starts anew)."""
    c = carry_last(calls, keys, order, F.col(action), "_before", inclusive=False)
    c = running_sum(c, keys, order, F.when(F.col("_before") == F.col(action), 0).otherwise(1), "_run")
    c = running_sum(c, [*keys, "_run"], order, F.lit(1), "_nth")
    return c.withColumn("skipped", F.col("_nth") % limit == 0).drop("_before", "_run", "_nth")


def compress_transcripts(messages: DataFrame, keys: list[str], order: str, max_messages: int = 80, keep: int = 20) -> DataFrame:
    """Long transcripts as first message, one summary line for the middle, and the last ``keep`` messages."""
    n = messages.groupBy(*keys).agg(F.count("*").alias("n"))
    m = row_position(messages, keys, order, "k").join(n, keys)
    long = F.col("n") - 1 > max_messages
    middle = long & (F.col("k") > 1) & (F.col("k") <= F.col("n") - keep)
    kept = m.where(~middle).select(*keys, F.col(order).cast("bigint").alias(order), "role", "text")
    gone = m.where(middle).groupBy(*keys).agg(F.min(order).cast("bigint").alias(order), F.count("*").alias("c"))
    note = F.concat(F.lit("[이전 대화 "), F.col("c").cast("string"), F.lit("개 메시지]"))
    return kept.unionByName(gone.select(*keys, order, F.lit("user").alias("role"), note.alias("text")))
