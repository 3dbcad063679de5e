"""Runs of pages as state, and verdicts on what has landed so far, against plain Python."""

from __future__ import annotations

import random

from muster.operators import pages as P
from muster.streaming.spans import Spans
from muster.streaming.verdicts import judge


def plain_verdict(rows, reported):
    """``rows`` of (start, attempt, length, fault), all attempts at once."""
    by_start, grid = {}, []
    for start, *attempt in rows:
        by_start.setdefault(start, []).append(attempt)
    for start, attempts in sorted(by_start.items()):
        won = [(number, length) for number, length, fault in attempts if fault is None]
        fault = None if won else max(attempts)[2]
        if fault != P.REQUEST_ERROR:
            grid.append((start, min(won)[1] if won else 0, fault))
    expected, end, reach, first = 0, 0, None, {}
    for start, length, fault in grid:
        if fault:
            first.setdefault(fault, start)
        if start > expected:
            first.setdefault(P.GAP, start)
            reach = expected if reach is None else reach
        if start < expected:
            first.setdefault(P.OVERLAP, start)
        expected = start + length
        end = max(end, expected)
    for kind in (P.MISSING_ID_LIST, P.EMPTY_PAGE, P.GAP, P.OVERLAP):
        if first.get(kind, reported) < reported:
            return kind
    return P.INCOMPLETE if (end if reach is None else reach) < reported else P.OK


def test_verdicts_in_any_order_of_pages():
    random.seed(1)
    seen = set()
    for _ in range(5000):
        rows = []
        for place in range(0, 60, 10):
            kind = random.random()
            start = place - 5 if 0.12 < kind < 0.2 and place else place
            for attempt in range(0 if kind < 0.12 else random.choice([1, 1, 2])):
                fault = random.choice([None] * 6 + [P.REQUEST_ERROR, P.MISSING_ID_LIST, P.EMPTY_PAGE])
                rows.append((start, attempt, 0 if fault else random.choice([10, 10, 10, 15, 7]), fault))
        reported = random.choice([50, 55, 60])
        state = None
        for start, attempt, length, fault in sorted(random.sample(rows, len(rows)), key=lambda row: row[1]):
            spans = Spans(state)  # as after a restart
            for _ in range(2):  # and each page is replayed
                if fault:
                    spans.fail(start, attempt, fault)
                else:
                    spans.add(start, length)
            state = spans.dump()
        assert judge(Spans(state), reported) == plain_verdict(rows, reported)
        seen.add(judge(Spans(state), reported))
    assert seen == {P.MISSING_ID_LIST, P.EMPTY_PAGE, P.GAP, P.OVERLAP, P.INCOMPLETE, P.OK}


def test_unknown_counts():
    assert judge(Spans(), None) == judge(Spans(), -1) == P.UNKNOWN_COUNT
    assert judge(Spans(), 0) == P.OK and judge(Spans(), 1) == P.INCOMPLETE


def test_state_is_bounded_by_gaps_and_not_by_pages():
    random.seed(2)
    spans, largest = Spans(), 0
    order = [block * 10_000 + page * 100 for block in range(50) for page in random.sample(range(100), 100)]
    for start in order:  # out of order within a block of a hundred pages
        assert spans.add(start, 100) and not spans.add(start, 100)
        largest = max(largest, len(spans.dump()))
    assert spans.runs == [[0, 100, 5000]] and spans.totals() == (500_000, 5000)
    assert largest < 50 * 30  # at most fifty runs are open at a time
    spans.done = [500_000, 5000]
    assert spans.dump() == '{"done": [500000, 5000]}' and Spans(spans.dump()).done == [500_000, 5000]
