"""Due requests against the arithmetic of the backoff, whatever the order and the cuts of the log."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from muster.operators.retries import backoff_schedule
from muster.shared import fresh_path
from muster.streaming.due import ASK, GIVE_UP, Timer, queue_requests, stream_log

DELAY, ATTEMPTS = 100, 4


def plain(rows, upto):
    """All rows at once: ``(at, attempt, failed)``."""
    found, rows = [], sorted({r for r in rows if r[0] < upto and r[1] < ATTEMPTS})
    for number, (at, attempt, failed) in enumerate(rows):
        following = rows[number + 1][0] if number + 1 < len(rows) else None
        if not failed:
            break
        if attempt == ATTEMPTS - 1:
            found.append((attempt, at, GIVE_UP))
            break
        due = at + DELAY * 2**attempt
        if due < upto and (following is None or following > due):
            found.append((attempt + 1, due, ASK))
    return found


def test_any_order_within_the_lateness():
    rng = random.Random(7)
    kinds = set()
    for _ in range(3000):
        rows = [(rng.randrange(0, 2000, 50), rng.randrange(0, 5), rng.random() < 0.8) for _ in range(rng.randrange(0, 7))]
        late = rng.choice([0, 100, 500])
        landed = sorted(rows + rng.sample(rows, len(rows) // 2), key=lambda r: r[0] + rng.uniform(0, late))
        held, newest, found = None, 0, []
        for row in landed:
            now = newest - late  # the watermark before the batch
            if row[0] >= now:  # others are dropped as late: only replays are
                timer = Timer(DELAY, ATTEMPTS, json.loads(held) if held else None)
                timer.land(*row)
                found += timer.advance(now)
                held = json.dumps(timer.held())
            newest = max(newest, row[0])
        timer = Timer(DELAY, ATTEMPTS, json.loads(held) if held else None)
        found += timer.advance(newest - late)
        assert found == plain(rows, newest - late)
        kinds |= {action for _, _, action in found}
        upcoming = timer.next_time()
        assert upcoming is None or upcoming >= newest - late
    assert kinds == {ASK, GIVE_UP}


def test_a_success_cancels_and_an_ended_offset_keeps_a_flag():
    timer = Timer(DELAY, ATTEMPTS)
    timer.land(0, 0, True)
    assert list(timer.advance(50)) == [] and timer.next_time() == 100
    timer.land(100, 1, False)  # at the very time of the request
    assert list(timer.advance(10_000)) == [] and timer.held() == {"done": True} and timer.next_time() is None
    timer.land(20_000, 2, True)
    assert list(timer.advance(30_000)) == [] and timer.held() == {"done": True}


def _stream(spark, batches, **settings):
    landing, target, checkpoint = (fresh_path(spark, name) for name in ("landing", "due", "offsets"))
    schema = "dataset_id string, page_start bigint, attempt bigint, failed boolean, at_ms bigint, extra string"
    for rows in batches:
        log = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("at_ms"))
        log.write.mode("append").parquet(landing)
        queue_requests(stream_log(spark, landing), target, checkpoint, **settings).awaitTermination()
    due = spark.read.schema("dataset_id string, page_start bigint, attempt bigint, due_at timestamp, action string").parquet(target)
    return {tuple(r) for r in due.withColumn("due_at", F.unix_millis("due_at")).collect()}


def test_stream_equals_the_backoff_schedule(spark):
    """Every request fails, each attempt when it is due: what is asked for is the schedule itself."""
    delay, attempts, rows = 0.5, 3, []
    for dataset, start in (("a", 0), ("a", 100_000), (None, 7)):
        at = 1_000
        for attempt in range(attempts):
            rows.append((dataset, start, attempt, True, at, "x"))
            at += int(delay * 1000 * 2**attempt) + 10
    last = [("b", 0, 0, False, 100_000, None), (None, None, None, None, None, None)]
    found = _stream(spark, [rows[:4] + rows[:2], rows[4:] + rows[:1] + last], delay_seconds=delay, max_attempts=attempts, lateness="10 seconds")
    log = spark.createDataFrame(rows, "dataset_id string, page_start bigint, attempt bigint, failed boolean, at_ms bigint, extra string")
    waits = backoff_schedule(log, delay_seconds=delay, max_attempts=attempts).collect()
    began = {(d, s, a): at for d, s, a, _, at, _ in rows}
    expected = {
        (w.dataset_id, w.page_start, w.attempt + 1, began[w.dataset_id, w.page_start, w.attempt] + int(w.backoff_seconds * 1000), ASK)
        for w in waits
    }
    expected |= {(d, s, a, at, GIVE_UP) for (d, s, a), at in began.items() if a == attempts - 1}
    assert found == expected and len(found) == 9


@pytest.mark.parametrize("batches", [[[]], [[("a", 0, 0, False, 5, None)]]])
def test_nothing_is_due(spark, batches):
    assert _stream(spark, batches, delay_seconds=1.0, max_attempts=3) == set()
