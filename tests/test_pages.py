import random

import pytest

from muster.operators import pages as P
from muster.operators.retries import backoff_schedule, failed_datasets, retry_outcome
from muster.streaming.landing import append_identifiers, extracted_so_far, stream_pages


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, P.PAGE_SCHEMA).repartition(4)


def searches_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "dataset_id string, reported_count bigint")


def random_case(rng):
    """A reported count and, per offset, what the last request brought: a length, 0, or None."""
    size, reported = rng.choice([3, 5]), rng.choice([0, 1, 7, 12, 15])
    pages = {start: min(size, reported - start) for start in range(0, reported, size)}
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        if not pages:
            break
        start = rng.choice(list(pages))
        kind = rng.randrange(6)
        if kind == 0:
            del pages[start]
        elif kind == 1:
            pages[start] = 0
        elif kind == 2:
            pages[start] = None
        elif kind == 3 and pages[start]:
            pages[start] += rng.choice([-1, 2])
        elif kind == 4:
            pages[rng.randrange(reported + 6)] = rng.choice([0, 1, size])
        else:
            pages[reported + rng.randrange(5)] = size
    return reported, pages


def walk(reported, pages):
    """What a loop over the offsets would do with these pages: finish with a count, or not."""
    offset, used = 0, 0
    while offset < reported:
        length = pages.get(offset)
        if not length:
            return None
        offset, used = offset + length, used + 1
    return used == sum(1 for start in pages if start < reported)


def verdict(reported, pages):
    """The definition, by the pages in order."""
    end, found = 0, set()
    for start, length in sorted(pages.items()):
        if start >= reported:
            break
        found |= {"missing_id_list"} if length is None else {"empty_page"} if length == 0 else set()
        found |= {"gap"} if start > end else {"overlap"} if start < end else set()
        end = start + (length or 0)
    found |= {"incomplete"} if end < reported else set()
    order = ("missing_id_list", "empty_page", "gap", "overlap", "incomplete")
    return next((name for name in order if name in found), "ok")


@pytest.mark.parametrize("widths", [P.CELL_WIDTHS, (4, 8)])
def test_verdicts(spark, widths):
    rng = random.Random(11)
    cases = {f"d{i}": random_case(rng) for i in range(600)}
    rows = []
    for name, (_, pages) in cases.items():
        for start, length in pages.items():
            if rng.random() < 0.3:
                rows.append((name, start, 0, None, "timeout"))
            rows.append((name, start, 1, None if length is None else ["x"] * length, None))
            if length and rng.random() < 0.2:
                rows.append((name, start, 2, ["late"], None))
        if rng.random() < 0.1:
            rows.append((name, 2, 0, None, "timeout"))  # an offset that was never answered holds no page
    counts = {name: reported for name, (reported, _) in cases.items()}
    verdicts = P.page_verdict(pages_frame(spark, rows), searches_frame(spark, counts), widths=widths)
    found = {row.dataset_id: row for row in verdicts.collect()}
    seen = set()
    for name, (reported, pages) in cases.items():
        row = found[name]
        expected = verdict(reported, pages)
        seen.add(expected)
        assert row.verdict == expected, (name, reported, pages)
        assert (expected == "ok") == (walk(reported, pages) is True)
        assert row.raw_count == sum(length or 0 for length in pages.values())
    assert seen == {"missing_id_list", "empty_page", "gap", "overlap", "incomplete", "ok"}


def test_first_success_is_read(spark):
    rows = [
        ("d", 0, 0, None, "timeout"),
        ("d", 0, 1, [], None),
        ("d", 0, 2, ["b", "a"], None),
        ("d", 0, 3, ["late"], None),
        ("d", 2, 0, None, None),
        ("d", 2, 1, ["c"], None),
        ("e", 0, 5, ["too", "late"], None),
    ]
    read = P.flatten_pages(P.first_success(pages_frame(spark, rows), max_attempts=5))
    assert sorted(tuple(row) for row in read.collect()) == [("d", 0, "b"), ("d", 1, "a"), ("d", 2, "c")]


def test_one_huge_page(spark):
    rows = [("d", 0, 0, [str(i) for i in range(50_000)], None)]
    read = P.flatten_pages(pages_frame(spark, rows))
    assert read.where("ord = cast(id as bigint)").count() == 50_000


def test_progress_stops_at_one(spark):
    rows = [("d", 0, 0, ["a", "b"], None), ("d", 2, 0, ["c", "d", "e"], None)]
    progress = P.page_progress(pages_frame(spark, rows), searches_frame(spark, {"d": 4, "none": 0}))
    assert sorted(tuple(row) for row in progress.collect()) == [("d", 0, 2, 0.5), ("d", 2, 5, 1.0)]


def test_retries(spark):
    log = spark.createDataFrame(
        [("a", 0, 0, True), ("a", 0, 1, False), ("a", 0, 2, True)]
        + [("b", 0, i, True) for i in range(3)]
        + [("c", 0, 0, True)]
        + [("d", 0, i, i < 3) for i in range(4)],
        "dataset_id string, page_start bigint, attempt int, failed boolean",
    )
    found = {r.dataset_id: (r.winning_attempt, r.attempts_made, r.outcome) for r in retry_outcome(log, max_attempts=3).collect()}
    assert found == {
        "a": (1, 2, "succeeded"),
        "b": (None, 3, "exhausted"),
        "c": (None, 1, "pending"),
        "d": (None, 3, "exhausted"),
    }
    waits = backoff_schedule(log.where("dataset_id = 'b'"), delay_seconds=0.1, max_attempts=3).orderBy("attempt")
    assert [(r.attempt, round(r.backoff_seconds, 9)) for r in waits.collect()] == [(0, 0.1), (1, 0.2)]


def test_where_reading_ends(spark):
    rows = [
        ("d", 0, 0, ["a"], None),
        ("d", 1, 0, None, "first"),
        ("d", 1, 1, [], None),
        ("d", 2, 0, None, "x"),
        ("d", 2, 1, None, "y"),
        ("e", 0, 0, None, "x"),
        ("f", 0, 0, None, "x"),
        ("f", 0, 1, None, "y"),
        ("f", 0, 2, ["late"], None),
    ]
    found = failed_datasets(pages_frame(spark, rows), max_attempts=2)
    assert sorted(tuple(row) for row in found.collect()) == [("d", 1, 2, "empty_page"), ("f", 0, 2, "y")]
    unbounded = failed_datasets(pages_frame(spark, rows), max_attempts=None)
    assert sorted(tuple(row) for row in unbounded.collect()) == [("d", 1, 2, "empty_page"), ("e", 0, 1, "x")]


def test_unknown_counts(spark):
    rows = [("a", 0, 0, ["x", "y"], None), ("b", 0, 0, ["x"], None), ("c", 0, 0, ["x"], None)]
    searches = searches_frame(spark, {"a": None, "b": -1, "c": 1})
    found = {r.dataset_id: (r.raw_count, r.verdict) for r in P.page_verdict(pages_frame(spark, rows), searches).collect()}
    assert found == {"a": (2, "unknown_count"), "b": (1, "unknown_count"), "c": (1, "ok")}


def test_pages_as_they_arrive(spark, tmp_path):
    landing, target, offsets = (str(tmp_path / name) for name in ("landing", "ids", "offsets"))
    schema = "dataset_id string, ord bigint, id string"
    batches = [
        [("d", 0, 0, ["a", "b"], None), ("d", 2, 0, None, "timeout")],
        [("d", 2, 1, ["c"], None), ("e", 0, 0, ["z"], None)],
    ]
    expected = []
    for rows, new in zip(batches, ([("d", 0, "a"), ("d", 1, "b")], [("d", 2, "c"), ("e", 0, "z")])):
        spark.createDataFrame(rows, P.PAGE_SCHEMA).write.mode("append").parquet(landing)
        for _ in range(2):  # a second run finds nothing new
            append_identifiers(stream_pages(spark, landing), target, offsets).awaitTermination()
        expected += new
        read = spark.read.schema(schema).parquet(target)
        assert sorted(tuple(row) for row in read.collect()) == sorted(expected)
    counts = extracted_so_far(stream_pages(spark, landing))
    query = counts.writeStream.format("memory").queryName("extracted").outputMode("complete").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "counts")).start().awaitTermination()
    assert sorted(tuple(row) for row in spark.table("extracted").collect()) == [("d", 3), ("e", 1)]
