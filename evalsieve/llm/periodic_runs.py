"""Periodic runs of words, caught online.

Words are appended one by one. Whenever a block of 2^k words (at a multiple of 2^k) is
complete, it sets a catcher for the squares whose period is 2 to 4 times its length: the
first half of such a square holds a whole block, so the block comes again one period later.
A catcher waits under the last word of its block; an appended word wakes those that wait for
it, and one whose block stands there once more, at a distance of its range, starts a suffix
comparison: how far back the last words agree with those one period before. Every appended
word advances the comparisons that are open. One that ends after two periods was a square;
all squares of one period that it passed are one run.

A block that is itself periodic would come again at every shift of its own period. Its
catcher is set only when that inner run ends, for the block's length of words before the end
and the word that broke the run; those words have no small period, so each catcher starts at
most some six comparisons, and the work grows as n log n whatever the text. Every run of at
least three periods is caught. Of more exponent than two but under three, runs with a long
inner run may be missed; they are not reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from evalsieve.llm.common import BLANKS, ids_and_texts, map_batches

#: Least words and least periods of a run that is reported.
LEAST_WORDS = 24
LEAST_PERIODS = 3

_WORD = re.compile(f"[^{BLANKS}]+")


class SquareCatcher:
    """The runs of a growing sequence of hashable values, each at least `periods` (3 or more)
    periods and `words` values long."""

    def __init__(self, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS):
        if periods < 3:
            raise ValueError("runs of fewer than three periods are not all caught")
        self.words, self.periods = words, periods
        self._seen: list = []
        #: Under its last value: end, length, and size that sets the range, of what waits.
        self._waiting: dict = {}
        #: Period of each open comparison, and the first value that agrees.
        self._open: dict[int, int] = {}
        #: Start and end of the runs that are over, and their smallest period.
        self._runs: dict[tuple[int, int], int] = {}
        #: Comparisons started, and values that they looked at backwards; for tests of the bound.
        self.started = self.looked_back = 0

    def append(self, values: Iterable) -> None:
        """Append values, one after the other."""
        seen, waiting, open_ = self._seen, self._waiting, self._open
        i = len(seen) - 1
        back = [object(), object(), object(), *seen[-3:]]
        back1, back2, back3 = back[-1], back[-2], back[-3]
        for value in values:
            i += 1
            seen.append(value)
            if open_:
                for p in [p for p in open_ if seen[i - p] != value]:
                    self._end(p, open_.pop(p), i)
            # periods below four: blocks of one word, which need no table
            if value == back1 or value == back2 or value == back3:
                for p, other in ((1, back1), (2, back2), (3, back3)):
                    if other == value and p not in open_:
                        self._start(p, 1, i)
            back1, back2, back3 = value, back1, back2
            if value in waiting:
                self._wake(value, i)
            if i & 1:  # blocks that end here
                size = 2
                while not (i + 1) % size:
                    if not (open_ and self._inside(size, i)):
                        waiting.setdefault(value, []).append((i, size, size))
                    size *= 2

    def _inside(self, size: int, i: int) -> bool:
        """Whether the last `size` values lie in an open run of at most a third of their number."""
        return any(3 * p <= size and first - p <= i - size + 1 for p, first in self._open.items())

    def _wake(self, value, i: int) -> None:
        """Compare what waits for this value and is in its range; forget what is past it."""
        seen, woken, kept = self._seen, self._waiting[value], []
        for waiter in woken:
            end, length, size = waiter
            period = i - end
            if period < 4 * size:
                kept.append(waiter)
                if (
                    period >= 2 * size
                    and period not in self._open
                    and seen[i - 1] == seen[end - 1]
                    and self._same(i, end, length)
                ):
                    self._start(period, length, i)
        if len(kept) < len(woken):
            if kept:
                self._waiting[value] = kept
            else:
                del self._waiting[value]

    def _same(self, i: int, end: int, length: int) -> bool:
        """Whether the last `length` values before i and end agree, the nearest compared first."""
        seen, done, step = self._seen, 0, 8
        while done < length:
            step = min(step, length - done)
            a, b = i + 1 - done, end + 1 - done
            if seen[a - step : a] != seen[b - step : b]:
                return False
            done += step
            step *= 2
        return True

    def _start(self, period: int, length: int, i: int) -> None:
        """Open a comparison: `length` values up to i agree with those one period before."""
        at = i - length + 1
        for p, first in self._open.items():
            if period % p == 0 and first - p <= at - period:
                return  # a shorter period rules here
        seen = self._seen
        while at > period and seen[at - 1] == seen[at - 1 - period]:
            at -= 1
        self.started += 1
        self.looked_back += i - at + 1
        self._open[period] = at

    def _end(self, period: int, first: int, end: int) -> None:
        """Close a comparison that the value at `end` broke."""
        start = first - period
        self._note(self._runs, start, end, period)
        # blocks inside the run have left their catchers to its end
        size = 4
        while size < 3 * period:
            size *= 2
        while -(-start // size) * size + size <= end:
            self._waiting.setdefault(self._seen[end], []).append((end, size + 1, size))
            size *= 2

    def _note(self, runs: dict, start: int, end: int, period: int) -> None:
        if end - start >= max(self.words, self.periods * period):
            runs[start, end] = min(period, runs.get((start, end), period))

    def runs(self) -> list[tuple[int, int, int]]:
        """start, length, period of every run so far, by start and period; a run that goes on
        to the last value counts as it stands."""
        found = dict(self._runs)
        for period, first in self._open.items():
            self._note(found, first - period, len(self._seen), period)
        return sorted((start, end - start, period) for (start, end), period in found.items())


def runs_of(values: Iterable, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """start, length and period of the periodic runs of a sequence."""
    catcher = SquareCatcher(words, periods)
    catcher.append(values)
    return catcher.runs()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared exactly; of equals the first, then the shortest period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run repeats after its first period."""
    kept, at = [], 0
    for start, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > at:
            kept += words[at : max(at, start)]
            at = end
    return kept + words[at:]


_RUN = "struct<start:long,length:long,period:long>"


def find_runs(docs: DataFrame, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, `runs` (word number from 0, length and period in words, by start and period),
    `strongest` of them (null without a run) and `collapsed`, the text's words joined by one
    space without those that a run repeats.

    Words are parted by spaces and the controls from tab to carriage return. A null text, and
    one without words, has no runs and collapses to the empty text. Rows are handled one by
    one: repeated rows give repeated results, a null doc_id stays null, an empty table gives
    an empty one, and other columns, whatever their names, are not read. A text is one task's
    work, n log n in its words.
    """

    def run(columns):
        out: dict[str, list] = {"doc_id": columns["doc_id"], "runs": [], "strongest": [], "collapsed": []}
        for text in columns["text"]:
            own = _WORD.findall(text or "")
            number: dict[str, int] = {}
            found = runs_of([number.setdefault(w, len(number)) for w in own], words, periods)
            named = [dict(zip(("start", "length", "period"), r)) for r in found]
            best = strongest(found)
            out["runs"].append(named)
            out["strongest"].append(best and dict(zip(("start", "length", "period"), best)))
            out["collapsed"].append(" ".join(collapse(own, found)))
        return out

    return map_batches(
        ids_and_texts(docs), run,
        f"doc_id long, runs array<{_RUN}>, strongest {_RUN}, collapsed string",
    )
