"""Running prefixes, alerts at the first crossing and closing of idle cases, with transformWithState.

The state of a case is a line of numbers and a list of the events that the watermark has not passed yet; one event-time timer per
case says when it is looked at next: when a held event is due, when the case closes, when its state goes. Events that come late past
the watermark are dropped by Spark, which reports their count in the query progress. The state store must be RocksDB
(``rocksdb_state``), which keeps the state outside of the heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PREFIX, ALERT, CLOSED = "prefix", "alert", "closed"
OUTPUT = "case_id string, kind string, event_nr int, event_id bigint, so_far double, score double"
LINE = "n int, so_far double, alerted boolean, closed boolean, last_ms bigint, timer bigint"
NEW_CASE = (0, 0.0, False, False, 0, 0)
HELD = "ms bigint, event_id bigint, value double"
DAY_MS = 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CaseWatcher(StatefulProcessor):
    """See ``watch_cases``. Only the events of one case that are due at once are in memory."""

    def __init__(self, scale: float, confidence: float, emit: tuple[str, ...], idle_ms: int, settle_ms: int, keep_ms: int, hold: bool):
        self.scale, self.confidence, self.emit = scale, confidence, emit
        self.idle_ms, self.settle_ms, self.keep_ms, self.hold = idle_ms, settle_ms, keep_ms, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", LINE)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # no case: such a row only moves the watermark
            return
        line = self.line.get() if self.line.exists() else NEW_CASE
        came = [(r["ms"], r["event_id"], r["value"]) for r in rows]
        if self.hold:
            self.held.appendList(came)
            due = min(ms for ms, _, _ in came)
            self._store(line[:5], line[5], due if not line[5] else min(due, line[5]))
        else:
            line, out = self._follow(key[0], line, came)
            yield from out
            self._store(line[:5], line[5], self._idle_at(line))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, line = timerValues.getCurrentWatermarkInMs(), self.line.get()
        waiting: list = []
        if self.hold and self.held.exists():
            held = [tuple(h) for h in self.held.get()]
            due, waiting = [h for h in held if h[0] <= now], [h for h in held if h[0] > now]
            line, out = self._follow(key[0], line, due)
            yield from out
            if waiting:
                self.held.put(waiting)
            else:
                self.held.clear()
        n, so_far, alerted, closed, last_ms, _ = line
        if waiting:
            self._store(line[:5], 0, min(h[0] for h in waiting))
            return
        idle = now > last_ms + self.idle_ms + self.settle_ms
        if idle and not closed and not alerted and CLOSED in self.emit:
            yield self._closing(key[0], n, so_far)
        line = (n, so_far, alerted, closed or idle, last_ms)
        if now > self._idle_at(line):  # the watermark may pass the closing and the end of the mark at once
            self.line.clear()
        else:
            self._store(line, 0, self._idle_at(line))

    def _idle_at(self, line) -> int:
        """When a case without a waiting event is looked at next: to be closed, or to be forgotten."""
        return line[4] + self.idle_ms + self.settle_ms + (self.keep_ms if line[3] else 0) + 1

    def _store(self, facts: tuple, old: int, timer: int) -> None:
        if timer != old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.line.update((*facts, timer))

    def _follow(self, case: str, line, events: list) -> tuple[tuple, list[Row]]:
        """The line after these events, and what they give."""
        n, so_far, alerted, closed, last_ms, timer = line
        out = []
        for ms, event_id, value in sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or 0)):
            # a gap between two events closes the case before the later one, whichever batch they come in
            if self.hold and n and ms - last_ms > self.idle_ms and not closed and not alerted:
                closed = True
                if CLOSED in self.emit:
                    out.append(self._closing(case, n, so_far))
            n, so_far, last_ms = n + 1, so_far + (value or 0.0), max(last_ms, ms)
            score = so_far / (self.scale * n)
            if PREFIX in self.emit:
                out.append(Row(case_id=case, kind=PREFIX, event_nr=n, event_id=event_id, so_far=so_far, score=score))
            if score >= self.confidence and not alerted and not closed:
                alerted = True
                if ALERT in self.emit:
                    out.append(Row(case_id=case, kind=ALERT, event_nr=n, event_id=event_id, so_far=so_far, score=score))
        return (n, so_far, alerted, closed, last_ms, timer), out

    def _closing(self, case: str, n: int, so_far: float) -> Row:
        return Row(case_id=case, kind=CLOSED, event_nr=n, event_id=None, so_far=so_far, score=so_far / (self.scale * n))

    def close(self) -> None:
        pass


def watch_cases(
    stream: DataFrame,
    case: str,
    ts: str,
    event: str,
    value: str,
    scale: float,
    confidence: float,
    delay_ms: int = 3600 * 1000,
    idle_ms: int = DAY_MS,
    keep_ms: int = 7 * DAY_MS,
    emit: tuple[str, ...] = (ALERT, CLOSED),
    hold: bool = True,
) -> DataFrame:
    """Follow every case and emit the asked kinds of rows.

    prefix: one row per event with its number and the running sum of ``value`` (a null value adds nothing).
    alert: the first event where running sum / (scale * number) reaches ``confidence``; later events give none.
    closed: a case without alert that saw no event for ``idle_ms``, ``delay_ms`` later; the negative prediction.

    An event waits in the state until the watermark (the latest time less ``delay_ms``) passes it, so the rows are those of the
    batch answer for any order of arrival within ``delay_ms``; a state holds the events of one case within that time. With
    ``hold=False`` events are numbered as they come, in time order within a micro-batch only.

    A closed case keeps its mark for ``keep_ms``: its later events are numbered on, and give neither an alert nor a second closing.
    After that time without an event the state of the case is removed, alerted or not, and an event that comes later still begins it
    anew. Rows without a case give nothing and only move the watermark.
    """
    slim = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{delay_ms} milliseconds").select(
        F.col(case).cast("string").alias("case_id"), "_ts", F.unix_millis("_ts").alias("ms"),
        F.col(event).cast("bigint").alias("event_id"), F.col(value).cast("double").alias("value"))
    watcher = CaseWatcher(scale, confidence, emit, idle_ms, delay_ms if hold else 0, keep_ms, hold)
    return slim.groupBy("case_id").transformWithState(watcher, OUTPUT, "Append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(out: DataFrame, path: str, checkpoint: str):
    """Process what is there, write Parquet, and return the finished query."""
    with rocksdb_state(out.sparkSession):
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
            availableNow=True).start()
        query.awaitTermination()
    return query
