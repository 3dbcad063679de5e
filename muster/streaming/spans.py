"""Which offsets of a list have been read, as a state that stays small.

Pages of one length that follow each other are one run ``[start, length, count]``. A list read in pages of
a fixed size is one run, whatever its length and the order in which pages come; the state grows
with gaps that are still open and with changes of the page length, not with pages.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort


class Spans:
    """Pages by their offsets, and offsets that have failed so far."""

    def __init__(self, state: str | None = None) -> None:
        held = json.loads(state) if state else {}
        self.runs: list[list[int]] = held.get("runs", [])
        self.failed: dict[int, tuple[int, str]] = {int(k): tuple(v) for k, v in held.get("failed", {}).items()}
        self.done: list[int] | None = held.get("done")

    def dump(self) -> str:
        if self.done is not None:
            return json.dumps({"done": self.done})
        return json.dumps({"runs": self.runs, "failed": self.failed})

    def holds(self, start: int) -> bool:
        """Whether a page was read at this very offset."""
        return any(a <= start < a + n * k and (start - a) % n == 0 for a, n, k in self.runs)

    def add(self, start: int, length: int) -> bool:
        """Take a page up; False if there is one at its offset."""
        if self.holds(start):
            return False
        self.failed.pop(start, None)
        run = [start, length, 1]
        for other in [r for r in self.runs if r[1] == length]:
            if other[0] + length * other[2] == run[0]:
                self.runs.remove(other)
                run = [other[0], length, other[2] + run[2]]
            elif run[0] + length * run[2] == other[0]:
                self.runs.remove(other)
                run = [run[0], length, run[2] + other[2]]
        insort(self.runs, run)
        return True

    def fail(self, start: int, attempt: int, fault: str) -> None:
        """An attempt that brought nothing; of several the last one counts."""
        if not self.holds(start) and self.failed.get(start, (-1, ""))[0] <= attempt:
            self.failed[start] = (attempt, fault)

    def landed(self, silent: str) -> list[tuple[int, int, str | None]]:
        """``(start, end, fault)`` in order, a run as one; offsets whose fault is ``silent`` hold nothing."""
        marks = sorted(start for start, (_, fault) in self.failed.items() if fault != silent)
        found: list[tuple[int, int, str | None]] = [(m, m, self.failed[m][1]) for m in marks]
        cuts = sorted([a for a, _, _ in self.runs] + marks)
        for a, n, k in self.runs:
            # what begins inside a run cuts it after the page that it falls into
            inside = cuts[bisect_left(cuts, a + 1) : bisect_left(cuts, a + n * k)]
            pieces = sorted({a, a + n * k, *(a + n * -((a - c) // n) for c in inside)})
            found += [(one, two, None) for one, two in zip(pieces, pieces[1:], strict=False)]
        return sorted(found, key=lambda item: (item[0], item[1]))

    def totals(self) -> tuple[int, int]:
        """Identifiers and pages."""
        return sum(n * k for _, n, k in self.runs), sum(k for _, _, k in self.runs)
