"""Which offset to ask for again, and when: the retries of a log of requests, as timers on a stream.

The clock is the event time of the log. What a row means is decided when the watermark has passed it, in the
order of event time, so the requests are the same however the log is cut into files and batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CELL = 1 << 14  # offsets that share a state
ASK = "ask"
GIVE_UP = "give_up"
DUE = "dataset_id string, page_start bigint, attempt bigint, due_ms bigint, action string"


class Timer:
    """One offset: the rows that the watermark has not passed yet, and the request that waits for its time."""

    def __init__(self, delay_ms: float, max_attempts: int, held: dict | None = None) -> None:
        held = held or {}
        self.delay_ms, self.max_attempts = delay_ms, max_attempts
        self.rows: list[tuple[int, int, bool]] = [tuple(row) for row in held.get("rows", [])]
        self.waits: tuple[int, int] | None = tuple(held["waits"]) if held.get("waits") else None
        self.done: bool = held.get("done", False)

    def held(self) -> dict:
        """What is kept of the offset, for JSON."""
        return {"done": True} if self.done else {"rows": self.rows, "waits": self.waits}

    def land(self, at: int, attempt: int, failed: bool) -> None:
        """A row of the log; one that is there already changes nothing."""
        if not self.done and attempt < self.max_attempts and (at, attempt, failed) not in self.rows:
            self.rows.append((at, attempt, failed))

    def _ring(self, before: int) -> Iterator[tuple[int, int, str]]:
        if self.waits and self.waits[0] < before:
            due, attempt = self.waits
            self.waits = None
            yield attempt, due, ASK

    def advance(self, now: int) -> Iterator[tuple[int, int, str]]:
        """``(attempt, due, action)`` of what falls due before ``now``, the time that the watermark has reached."""
        self.rows.sort()
        while self.rows and not self.done and self.rows[0][0] < now:
            at, attempt, failed = self.rows.pop(0)
            yield from self._ring(at)
            self.waits = None
            if not failed:
                self.done = True
            elif attempt == self.max_attempts - 1:
                self.done = True
                yield attempt, at, GIVE_UP
            else:
                self.waits = (at + round(self.delay_ms * 2**attempt), attempt + 1)
        if not self.done:
            yield from self._ring(now)

    def next_time(self) -> int | None:
        """The event time at which something may happen without a new row."""
        times = [row[0] for row in self.rows[:1]] + ([self.waits[0]] if self.waits else [])
        return min(times) if times and not self.done else None


def _fire(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, delay_ms: float, max_attempts: int
) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {}
    timers = {int(start): Timer(delay_ms, max_attempts, one) for start, one in held.items()}
    if not state.hasTimedOut:
        for frame in frames:
            rows = zip(frame["page_start"], frame["at_ms"], frame["attempt"], frame["failed"], strict=True)
            for start, at, attempt, failed in rows:
                if start not in timers:
                    timers[start] = Timer(delay_ms, max_attempts)
                timers[start].land(int(at), int(attempt), bool(failed))
    now = state.getCurrentWatermarkMs()
    fired = [(key[0], start, *one) for start, timer in timers.items() for one in timer.advance(now)]
    state.update((json.dumps({start: timer.held() for start, timer in timers.items()}),))
    upcoming = [time for time in (timer.next_time() for timer in timers.values()) if time is not None]
    if upcoming:
        state.setTimeoutTimestamp(max(min(upcoming), now + 1))
    if fired:
        yield pd.DataFrame(fired, columns=["dataset_id", "page_start", "attempt", "due_ms", "action"])


def due_requests(
    log: DataFrame, *, delay_seconds: float, max_attempts: int, lateness: str = "0 seconds", cell: int = CELL
) -> DataFrame:
    """``(dataset_id, page_start, attempt, due_at, action)`` of a stream ``(dataset_id, page_start, attempt, failed, at)``.

    A failure of attempt ``n`` at time ``t`` asks for attempt ``n + 1`` at ``t + delay * 2**n`` (``ask``), unless a
    success, or a later row of the offset, came up to then; the last attempt allowed ends the offset (``give_up``), and so
    does a success. A row is emitted when the watermark, ``lateness`` behind the newest row, has passed its time. Times
    count in milliseconds; rows of one time are taken by attempt, a success before a failure of the same attempt.

    State: for an offset, the rows within ``lateness``, and one waiting request; a flag once it has ended. ``cell`` offsets
    share a state, and its timer rings for the first of them, so a long list is spread over tasks. Rows that land twice change nothing; rows that come later than ``lateness``
    are dropped. Rows with a null offset, attempt, time or outcome are not looked at. A null ``dataset_id`` is a list of its own.
    """
    whole = log.dropna(subset=["page_start", "attempt", "failed", "at"])
    narrow = whole.withWatermark("at", lateness).select(
        "dataset_id", F.floor(F.col("page_start") / cell).cast("bigint").alias("_cell"), F.col("page_start").cast("bigint").alias("page_start"), F.col("attempt").cast("bigint").alias("attempt"),
        "failed", "at", F.unix_millis("at").alias("at_ms"),
    )

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _fire(key, frames, state, delay_seconds * 1000, max_attempts)

    fired = narrow.groupBy("dataset_id", "_cell").applyInPandasWithState(
        run, DUE, "timers string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fired.withColumn("due_at", F.timestamp_millis("due_ms")).select("dataset_id", "page_start", "attempt", "due_at", "action")


def queue_requests(
    log: DataFrame, path: str, checkpoint: str, *, delay_seconds: float, max_attempts: int, lateness: str = "0 seconds",
    cell: int = CELL,
) -> StreamingQuery:
    """Append what is due to the table at ``path``, once, also over restarts."""
    due = due_requests(log, delay_seconds=delay_seconds, max_attempts=max_attempts, lateness=lateness, cell=cell)
    return (
        due.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The log of requests as its files arrive under ``path``."""
    schema = "dataset_id string, page_start bigint, attempt bigint, failed boolean, at timestamp"
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)
