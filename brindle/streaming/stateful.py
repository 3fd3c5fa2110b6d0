"""Streams with state of their own per key: the memory of conversations, and the states of jobs with their reclaim.

Both are transformWithState with event-time timers, so that keys that fall silent give their state back; the rows they give are
those of the batch rules, however the input is cut into batches. Input of a key must come in order of time, within what the
watermark allows. The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Turns that a conversation remembers, minutes of silence after which it forgets, seconds after which a running job is given up.
MAX_TURNS, TIMEOUT_MINUTES, STALE_SECONDS = 5, 30, 1800


class Memory(StatefulProcessor):
    """A ring of a conversation's last turns; a silence of more than the timeout clears it, and so does its timer."""

    def __init__(self, max_turns: int, timeout_ms: int):
        self.max_turns, self.timeout_ms = max_turns, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint")
        self.last = handle.getValueState("last", "ms bigint")

    def _silence(self) -> None:
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [t[0] for t in self.turns.get()] if self.turns.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r.ms, r.turn)):
            if last is not None and r.ms - last > self.timeout_ms:
                held = []
            last, held = r.ms, [*held, r.turn][-self.max_turns :]
            yield Row(conv_id=key[0], turn=r.turn, held=len(held), recent=",".join(map(str, held)))
        self.turns.put([(t,) for t in held])
        self.last.update((last,))
        self._silence()
        self.handle.registerTimer(last + self.timeout_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.turns.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def conversation_memory(turns: DataFrame, lateness: str = "10 minutes", max_turns: int = MAX_TURNS, timeout_minutes: float = TIMEOUT_MINUTES) -> DataFrame:
    """(conv_id, turn, held, recent) of each turn of a stream (conv_id, turn, ts): the turns in memory once it is there."""
    stamped = turns.selectExpr("conv_id", "cast(turn AS bigint) AS turn", "cast(ts AS timestamp) AS ts").withWatermark("ts", lateness).selectExpr("*", "unix_millis(ts) AS ms")
    return stamped.groupBy("conv_id").transformWithState(Memory(max_turns, int(timeout_minutes * 60_000)), "conv_id bigint, turn bigint, held int, recent string", "Append", "EventTime")


class Jobs(StatefulProcessor):
    """A job's state; one that runs for longer than it may becomes pending again, by its next event or by its timer."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        started = self.started.get()[0] if self.started.exists() else None
        for r in sorted(rows, key=lambda r: (r.ms, r.status)):
            if started is not None and r.ms - started > self.stale_ms:
                yield Row(job=key[0], status="pending", ms=started + self.stale_ms + 1, reclaimed=True)
            started = r.ms if r.status == "running" else None
            yield Row(job=key[0], status=r.status, ms=r.ms, reclaimed=False)
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        if started is None:
            self.started.clear()
        else:
            self.started.update((started,))
            self.handle.registerTimer(started + self.stale_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.started.exists():
            started = self.started.get()[0]
            self.started.clear()
            yield Row(job=key[0], status="pending", ms=started + self.stale_ms + 1, reclaimed=True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, lateness: str = "1 minute", stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """(job, status, ms, reclaimed) of a stream (job, status, at): each state that a job takes, and those given back to the queue."""
    stamped = events.selectExpr("job", "status", "cast(at AS timestamp) AS at").withWatermark("at", lateness).selectExpr("*", "unix_millis(at) AS ms")
    return stamped.groupBy("job").transformWithState(Jobs(stale_seconds * 1000), "job bigint, status string, ms bigint, reclaimed boolean", "Append", "EventTime")
