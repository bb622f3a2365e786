"""Job life cycles in event-time order, as a stream with keyed state and as a batch of joins.

A stream may bring a job's events in any order within the watermark's delay, over several micro-batches and Arrow batches. Each job's events wait in a state list until the watermark
has passed them and are then replayed by (ts, event_id), so the outcome depends on event time alone and equals the batch form. The event that ends a job closes it: later
ones are dropped. The time ``keep_ms`` after the end a timer removes what is known of the job; from then on the same id would begin a new one.

Events: job_id, event_id (unique within a job), ts and further columns. Events without a job or a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.streaming.jobs import TERMINAL

#: Which status may follow which; a job begins as queued, is cancelled only while it runs, and ends once.
FOLLOWS = {None: ("queued",), "queued": ("processing", "failed"), "processing": ("completed", "failed", "cancelled")}
ENDS = ("completed", "failed", "cancelled")
#: Stream states need a store that holds lists and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Events of a job that wait together in one entry of its list: each entry is sent, parsed and stored on its own.
PACKED = 1000

_OUT = "job_id bigint, payload string, before string, allowed boolean"


def _packed(held: list[tuple]) -> list[tuple[str]]:
    return [(json.dumps(held[k:k + PACKED], ensure_ascii=False),) for k in range(0, len(held), PACKED)]


class InOrder(StatefulProcessor):
    """Replays the events of a key in event-time order; subclasses say what an event does to the status and whether it ends the key."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def moved(self, status: str | None, wanted: str) -> tuple[str | None, bool, bool]:
        """(status after the event, allowed, ends the key)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, ended bigint")
        self.pending = handle.getListState("pending", "events string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        _, ended = self.state.get() or (None, None)
        first, held = None, ((r.at, r.event_id, r.wanted, r.payload) for r in rows if self._counts(ended, r.at))
        while part := list(islice(held, PACKED)):
            self.pending.appendList(_packed(part))
            first = min([h[0] for h in part] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield from ()

    def _counts(self, ended: int | None, at: int) -> bool:
        """Whether an event still matters to a key that ended at ``ended``: only once the end is forgotten."""
        return ended is None or at > ended + self.keep_ms * 1000

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        status, ended = self.state.get() or (None, None)
        if not self._counts(ended, passed):
            return
        if ended is not None:
            status = ended = None
            self.state.clear()
        held = sorted((tuple(h) for packed in self.pending.get() for h in json.loads(packed[0])), key=lambda h: h[:2])
        out, done = [], 0
        for at, _, wanted, payload in held:
            if at > passed or ended is not None:
                break
            before, done = status, done + 1
            status, allowed, ends = self.moved(status, wanted)
            out.append(Row(job_id=key[0], payload=payload, before=before, allowed=allowed))
            ended = at if ends else None
        rest = [h for h in held[done:] if self._counts(ended, h[0])]
        if out:
            self.state.update((status, ended))
        if len(rest) < len(held):
            if rest:
                self.pending.put(_packed(rest))
            else:
                self.pending.clear()
        if ended is not None:
            self._wake(ended + self.keep_ms * 1000 + 1)
        elif rest:
            self._wake(rest[0][0])
        yield from out

    def close(self) -> None:
        pass


class Lifecycle(InOrder):
    """Status changes by the rules; a forbidden one changes nothing."""

    def moved(self, status, wanted):
        allowed = wanted in FOLLOWS[status]
        return (wanted if allowed else status), allowed, allowed and wanted in ENDS


class UntilTerminal(InOrder):
    """Every event up to the terminal one."""

    def moved(self, status, wanted):
        return wanted, True, wanted in TERMINAL


def _replayed(events: DataFrame, wanted: Column, processor: InOrder, delay: str, mode: str) -> DataFrame:
    """The events in order with (before, allowed); ``events`` is a stream."""
    known = events.where("job_id is not null and ts is not null")
    rest = [c for c in events.columns if c not in ("job_id", "ts")]
    rows = known.withWatermark("ts", delay).select(
        F.col("job_id").cast("bigint").alias("job_id"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("bigint").alias("event_id"), wanted.alias("wanted"),
        F.to_json(F.struct(F.unix_micros("ts").alias("at"), *rest)).alias("payload"),
    )
    out = rows.groupBy("job_id").transformWithState(processor, _OUT, mode, "EventTime")
    schema = ", ".join(["at bigint", *(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in rest)])
    read = F.from_json("payload", schema)
    return out.select("job_id", F.timestamp_micros(read["at"]).alias("ts"), *[read[c].alias(c) for c in rest], "before", "allowed")


def lifecycle_stream(events: DataFrame, delay: str = "10 minutes", keep_ms: int = 86_400_000, mode: str = "append") -> DataFrame:
    """Streaming form of :func:`lifecycle`: each event once the watermark has passed it."""
    return _replayed(events, F.col("status"), Lifecycle(keep_ms), delay, mode)


def until_terminal_stream(events: DataFrame, delay: str = "10 minutes", keep_ms: int = 86_400_000, mode: str = "append") -> DataFrame:
    """Events up to and including the job's first terminal one, in event-time order; the state of an ended job is removed ``keep_ms`` after its end."""
    return _replayed(events, F.col("type"), UntilTerminal(keep_ms), delay, mode).drop("before", "allowed")


def lifecycle(events: DataFrame) -> DataFrame:
    """``events`` (job_id, event_id, ts, status) with the status before each and whether the change was allowed; events after the job's end are dropped.

    Statuses only move forward, so three moments tell everything: the first queued event, the first processing event after it, and the first end that either allows. Each is a minimum per job, added up
    map-side, so a job with a large share of the events is no hot spot in a window.
    """
    events = events.where("job_id is not null and ts is not null")
    at = F.struct("ts", "event_id")
    first = lambda rows, test, name: rows.where(test).groupBy("job_id").agg(F.min(at).alias(name))
    queued = events.join(first(events, F.col("status") == "queued", "q"), "job_id", "left")
    failed = first(queued, (F.col("status") == "failed") & (at > F.col("q")), "f")
    running = first(queued, (F.col("status") == "processing") & (at > F.col("q")), "p")
    moments = queued.join(running, "job_id", "left").join(failed, "job_id", "left")
    ended = first(moments, F.col("status").isin("completed", "cancelled") & (at > F.col("p")), "c")
    told = moments.join(ended, "job_id", "left").withColumn("end", F.least("f", "c"))
    before = F.when(at > F.col("p"), "processing").when(at > F.col("q"), "queued")
    allowed = F.coalesce((at == F.col("q")) | (at == F.col("p")) | (at == F.col("end")), F.lit(False))
    told = told.where(F.col("end").isNull() | (at <= F.col("end")))
    return told.select(*events.columns, before.alias("before"), allowed.alias("allowed"))
