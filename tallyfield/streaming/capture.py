"""The lifecycle of capture sessions as one state machine over a stream of polls.

A poll says whether the endpoint answered, how many events and whether a snapshot were new, whether they could be stored, and
whether the capture was asked to stop. A session is active from its first poll. It ends when it is asked to stop, when the
endpoint has been missing ``max_misses`` times in a row, or when nobody has polled for longer than ``silence`` (the process is gone).
State is a few counters for each active session; an end or the timer of the silence removes it. A later poll begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyfield.streaming.live import LATENESS, run_available

MAX_MISSES = 150
SILENCE_SECONDS = 750
_STATE = "started long, last long, polls long, events long, snapshots long, store_errors long, misses long"
LIFECYCLE = "session_id long, started long, ended long, status string, polls long, events long, snapshots long, store_errors long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["t", "reachable", "stored", "events", "snapshot", "stop"]


def ending(events: int, snapshots: int, store_errors: int, misses: int, max_misses: int) -> str:
    """What a session that ends of itself is called; an empty capture is never complete, nor one that lost something."""
    if not events and not snapshots:
        return "partial_storage_errors" if store_errors else "partial_no_data"
    if misses >= max_misses:
        return "partial_endpoint_lost"
    return "partial_storage_errors" if store_errors else "completed"


class CaptureMachine(StatefulProcessor):
    def __init__(self, max_misses: int, silence: int) -> None:
        self.max_misses, self.silence = max_misses, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("capture", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        polls = sorted((tuple(r[c] for c in _FIELDS) for r in rows if r["t"] is not None), key=itemgetter(0))  # a session's polls of one trigger
        if key[0] is None or not polls:
            return
        before, out = self.state.get(), []
        now = list(before) if before else None
        for t, reachable, stored, events, snapshot, stop in polls:
            if now and t - now[1] > self.silence * 1_000_000:
                out.append(self._ended(key, now, "partial_process_restart"))
                now = None
            now = now or [int(t), int(t), 0, 0, 0, 0, 0]
            now[1], now[2] = int(t), now[2] + 1
            now[6] = 0 if reachable else now[6] + 1
            if reachable and stored:
                now[3], now[4] = now[3] + int(events), now[4] + int(snapshot)
            elif reachable:
                now[5] += 1
            if stop or now[6] >= self.max_misses:
                out.append(self._ended(key, now, ending(*now[3:7], self.max_misses)))
                now = None
        if before:  # a state has the timer of its last poll and no other
            self.handle.deleteTimer(self._due(before))
        if now:
            self.state.update(tuple(now))
            self.handle.registerTimer(self._due(now))
        elif before:
            self.state.clear()
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.state.get()
        if before:
            self.state.clear()
            yield self._ended(key, before, "partial_process_restart")

    def _due(self, now: list | tuple) -> int:
        return now[1] // 1000 + self.silence * 1000 + 1

    @staticmethod
    def _ended(key, now: list | tuple, status: str) -> Row:
        return Row(session_id=key[0], started=now[0], ended=now[1], status=status, polls=now[2], events=now[3], snapshots=now[4], store_errors=now[5])

    def close(self) -> None:
        pass


def lifecycle(polls: DataFrame, max_misses: int = MAX_MISSES, silence: int = SILENCE_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Stream: one row for each session that has ended, with times in microseconds (``ended`` is its last poll).

    ``polls``: session_id, ts, reachable, stored, events, snapshot, stop. Nulls are what a quiet poll has: reachable and
    stored, no events, no snapshot, no stop. Polls without a time or later than the lateness are left out; those without a
    session only let time pass.
    """
    quiet = {"reachable": True, "stored": True, "events": 0, "snapshot": False, "stop": False}
    plain = polls.withWatermark("ts", lateness).select(F.col("session_id").cast("long").alias("session_id"), "ts", F.unix_micros("ts").alias("t"), *[F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in quiet.items()])
    return plain.groupBy("session_id").transformWithState(CaptureMachine(max_misses, silence), LIFECYCLE, "append", "EventTime")


@contextmanager
def _state_store(spark):
    """Timers and typed state need the store on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_lifecycle(polls: DataFrame, name: str = "lifecycle", **options) -> DataFrame:
    """The lifecycle of what a source has now, in the shared folder."""
    with _state_store(polls.sparkSession):
        return run_available(lifecycle(polls, **options), name)
