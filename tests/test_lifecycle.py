"""Life cycles and keyed tables: streams against loops, whatever the arrival order, batch size or restart."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs as jb
from ledgerloom.streaming import keyed, lifecycle

T0 = datetime(2024, 1, 1)
STATUSES = ["queued", "processing", "completed", "failed", "cancelled"]


@pytest.fixture(scope="module")
def own(spark):
    s = spark.newSession()
    for k, v in (lifecycle.STORE, ("spark.sql.shuffle.partitions", "2"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "3"), ("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch", "3")):
        s.conf.set(k, v)
    return s


def replay(rows):
    """The contract, one event at a time; ``rows``: job, id, ts, status."""
    out, state = [], {}
    for job, i, ts, want in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        now = state.get(job)
        if now in lifecycle.ENDS:
            continue
        ok = want in lifecycle.FOLLOWS[now]
        out.append((job, i, want, now, ok))
        state[job] = want if ok else now
    return sorted(out, key=str)


def events(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), i, T0 + timedelta(seconds=rng.randrange(3 * n) // 4), rng.choice([*STATUSES, "queued", "processing", None])) for i in range(n)]
    return rows + [(None, n, T0, "queued"), (3, n + 1, None, "queued")]


def streamed(spark, rows, columns, folder, batches):
    for part in batches:
        spark.createDataFrame(pd.DataFrame([rows[k] for k in part], columns=[c.split()[0] for c in columns.split(", ")], dtype=object), columns).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream, folder, mode="append"):
    """What a stream emits, kept by id of its micro-batch."""
    got = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", f"{folder}-cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return got


@pytest.mark.parametrize("mode", ["append", "update"])
def test_lifecycle_in_any_arrival_order(own, tmp_path, mode):
    rows = events(160, 5)
    rows.append((99, 900, T0 + timedelta(days=9), "queued"))  # lets the watermark pass
    order = list(range(160))
    random.Random(1).shuffle(order)
    columns = "job_id bigint, event_id bigint, ts timestamp, status string"
    stream = streamed(own, rows, columns, str(tmp_path / "in"), [order[:50], order[50:90], [*order[90:], 160, 161], [162]])
    got = drained(lifecycle.lifecycle_stream(stream, "1 day", mode=mode), str(tmp_path / "in"), mode)
    want = replay(rows[:-1])
    assert sorted(((r.job_id, r.event_id, r.status, r.before, r.allowed) for r in got if r.job_id != 99), key=str) == want
    at = {r[1]: r[2] for r in rows}
    assert all(r.ts == at[r.event_id] for r in got) and any(not w[4] for w in want)
    seen = {}
    for r in got:  # emitted in order within a job
        assert seen.get(r.job_id, (T0, -1)) <= (r.ts, r.event_id)
        seen[r.job_id] = (r.ts, r.event_id)
    batch = lifecycle.lifecycle(own.createDataFrame(pd.DataFrame(rows[:-1], columns=["job_id", "event_id", "ts", "status"], dtype=object), columns))
    assert sorted(((r.job_id, r.event_id, r.status, r.before, r.allowed) for r in batch.collect()), key=str) == want


def test_state_is_gone_after_the_timer(own, tmp_path):
    rows = [(1, 1, T0, "queued"), (2, 2, T0, "queued"), (2, 3, T0 + timedelta(minutes=1), "failed"), (1, 4, T0 + timedelta(minutes=2), "processing"), (3, 5, T0 + timedelta(hours=1), "queued"), (2, 6, T0 + timedelta(hours=2), "queued")]
    columns = "job_id bigint, event_id bigint, ts timestamp, status string"
    stream = streamed(own, rows, columns, str(tmp_path / "in"), [[0, 1, 2], [3, 4], [5]])
    got = drained(lifecycle.lifecycle_stream(stream, "0 seconds", keep_ms=600_000), str(tmp_path / "in"))
    # job 2 ended at minute 1 and was forgotten at minute 11; a late queued event begins it anew
    assert [(r.event_id, r.before, r.allowed) for r in got if r.job_id == 2] == [(2, None, True), (3, "queued", True), (6, None, True)]
    left = own.read.format("statestore").option("path", f"{tmp_path}/in-cp").option("stateVarName", "state").load()
    assert {r.key["job_id"] for r in left.select("key").collect()} == {1, 2, 3}
    assert {r.key["job_id"] for r in left.where("value.ended is not null").select("key").collect()} == set()


def test_waiting_events_share_an_entry(own, tmp_path):
    rows = [(1, k, T0 + timedelta(seconds=k), "queued") for k in range(50)]
    stream = streamed(own, rows, "job_id bigint, event_id bigint, ts timestamp, status string", str(tmp_path / "in"), [range(30), range(30, 50)])
    assert not drained(lifecycle.lifecycle_stream(stream, "1 day"), str(tmp_path / "in"))
    left = own.read.format("statestore").option("path", f"{tmp_path}/in-cp").option("stateVarName", "pending").load()
    assert left.count() == 2


def test_until_terminal_keeps_all_columns(own, tmp_path):
    kinds = ["log", "progress", "log", "complete", "error"]
    rng = random.Random(2)
    rows = [(i, T0 + timedelta(milliseconds=rng.randrange(90_000)), rng.randrange(6), rng.choice(kinds), rng.choice([None, 7]), rng.choice([None, "말\"'\n", "x"])) for i in range(120)]
    rows.append((500, T0 + timedelta(days=2), 99, "log", None, None))
    columns = "event_id bigint, ts timestamp, job_id bigint, type string, progress bigint, message string"
    stream = streamed(own, rows, columns, str(tmp_path / "in"), [range(0, 40), range(40, 80), range(80, 120), [120]])
    got = drained(lifecycle.until_terminal_stream(stream, "1 hour"), str(tmp_path / "in"))
    batch = jb.until_terminal(own.createDataFrame(pd.DataFrame(rows[:-1], columns=[c.split()[0] for c in columns.split(", ")], dtype=object), columns))
    pick = lambda rs: sorted(((r.event_id, r.ts, r.job_id, r.type, r.progress, r.message) for r in rs if r.job_id != 99), key=str)
    assert pick(got) == pick(batch.collect())


def test_retention_with_late_and_repeated_jobs(own, tmp_path):
    hour = lambda h: T0 + timedelta(hours=h)
    rows = [(1, hour(0)), (2, hour(1)), (1, hour(0)), (3, hour(30)), (4, hour(2)), (5, hour(31)), (3, hour(30)), (6, hour(10)), (7, hour(40))]
    columns = "job_id bigint, created_at timestamp"
    stream = streamed(own, rows, columns, str(tmp_path / "in"), [[0, 1, 2], [3], [5, 6], [4, 7, 8]])
    table = keyed.KeyedTable(str(tmp_path / "jobs"), "job_id", {"created_at": "timestamp"}).create(own)
    q = keyed.retention_stream(stream, table, str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert q.exception() is None
    batch = jb.drop_old(own.createDataFrame(rows, columns).dropDuplicates(["job_id"]), F.lit(hour(40)))
    assert sorted(map(tuple, table.read(own).collect())) == sorted(map(tuple, batch.collect())) == [(3, hour(30)), (5, hour(31)), (7, hour(40))]
    repeats = [r.job_id for r in drained(keyed.distinct_recent(own.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), str(tmp_path / "again"))]
    assert len(repeats) == len(set(repeats)) and 4 not in repeats  # 28 hours late


def test_upserts_survive_replays_and_any_order(own, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(8), i, rng.choice([None, *STATUSES]), rng.choice([None, rng.randrange(100)])) for i in range(90)]
    rng.shuffle(rows)
    columns = "job_id bigint, event_id bigint, status string, progress bigint"
    frames = [own.createDataFrame(rows[k : k + 30], columns) for k in (0, 30, 60)]
    table = keyed.KeyedTable(str(tmp_path / "t"), "job_id", {"status": "string", "progress": "bigint"}).create(own)
    assert table.read(own).count() == 0
    done = [table.apply(f, k, "event_id") for k, f in ((0, frames[0]), (1, frames[1]), (1, frames[2]), (0, frames[2]), (2, frames[2]), (2, frames[2]))]
    assert done == [True, True, False, False, True, False]
    want = {}
    for job, i, status, progress in sorted(rows, key=lambda r: r[1]):
        old = want.get(job, (None, None))
        want[job] = (status if status is not None else old[0], progress if progress is not None else old[1])
    assert {r.job_id: (r.status, r.progress) for r in table.read(own).collect()} == want
    # a batch that wrote its rows but never committed is not seen, and can be done again
    own.createDataFrame([], table._schema()).write.mode("overwrite").parquet(f"{table.path}/slot{1 - table._committed(own)[1]}")
    assert table.read(own).count() == len(want)


def test_upsert_stream_restarts(own, tmp_path):
    columns = "job_id bigint, event_id bigint, status string, progress bigint"
    table = keyed.KeyedTable(str(tmp_path / "t"), "job_id", {"status": "string", "progress": "bigint"}).create(own)
    for k, row in enumerate([(1, 5, "queued", 10), (1, 9, "processing", None), (1, 7, "failed", 30)]):
        own.createDataFrame([row], columns).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(columns).parquet(str(tmp_path / "in"))
        keyed.upsert_stream(stream, table, "event_id", str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in table.read(own).collect()] == [(1, "processing", 30)]
