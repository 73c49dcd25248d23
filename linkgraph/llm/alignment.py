"""Cheapest edits that turn a sequence of turns into ``(s?(ua)+)?``: Wagner-Fischer against every feasible length.

Turns are letters: ``s``, ``u``, ``a`` by role, ``o`` for other roles, upper case
where the text is cut off, ``x`` where the turn has to go.  The grammar's
strings of one ending share their suffixes, so one table serves all feasible
lengths: ``table[i, r]`` is the cost of aligning the turns from ``i`` on with the
last ``r`` letters.  Ukkonen's band comes from an incumbent, a repair that only
changes roles and adds at most two turns: a cell that is further off the
diagonal than its cost allows is never looked at.  Every length that reaches the
lowest cost is traced back, always by the least letter first, and the least audit wins.

A long conversation is cut into segments.  A segment starts and ends in one of
four phases of the grammar (nothing yet, after ``s``, after ``u``, after ``a``);
``costs`` gives the cost between each two, and ``walk`` the edits once the costs
beyond the segment are known.  Insertions stand before a turn of their own segment, after
all deletions that are due; only the last segment may end with some.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 40
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (0, FAR, FAR, 0)
LETTERS = {"u": 0, "a": 1, "s": 2, "o": 3}
REMEMBERED = 20_000


class Walk(NamedTuple):
    cost: int
    exit: int
    edits: tuple[str, ...]  # one a turn: insertions ("u", "a") before it, then K, D, U or A (role changed); then what follows the last turn


def audit_of(edits: tuple[str, ...]) -> str:
    return "".join(edits).translate(str.maketrans("uaUA", "IIRR"))


class Segment:
    def __init__(self, codes: str, last: bool):
        self.codes, self.last = codes, last
        free = [c for c in codes if c != "x"]
        self.kinds = np.array([LETTERS[c.lower()] for c in free], dtype=np.int64)
        self.extra = np.array([CUT_OFF if c.isupper() else 0 for c in free], dtype=np.int64)
        self.forced = DELETE * (len(codes) - len(free))
        self.n = len(free)
        self.band = max(self._incumbent(start, end) for start in range(4) for end in (USER, ASSISTANT)) // min(INSERT, DELETE)
        self.tables: dict[int, np.ndarray] = {}

    def _letters(self, end: int) -> np.ndarray:
        """The letter with ``r`` letters left, for each ``r``."""
        return (np.arange(self.n + self.band + 1) + (end == USER)) % 2

    @staticmethod
    def _fits(start: int, end: int, left: int) -> bool:
        """Whether ``left`` letters lead from one phase to the other."""
        return left % 2 == (start == USER) ^ (end == USER) and (left > 0 or start == end)

    def _incumbent(self, start: int, end: int) -> int:
        if not self.n and not self.last:
            return 0
        left = next(r for r in range(self.n, self.n + 4) if self._fits(start, end, r))
        places = np.arange(left, left - self.n, -1)
        places[-1:] = 1
        wanted = (places + (end == USER)) % 2
        return int(INSERT * (left - self.n) + self.extra.sum() + REROLE * (wanted != self.kinds).sum())

    def table(self, end: int) -> np.ndarray:
        """Costs by (turn, letters left + 1); column 0 is out of reach."""
        if end not in self.tables:
            n, band, letters = self.n, self.band, self._letters(end)
            found = np.full((n + 1, n + band + 2), FAR, dtype=np.int64)
            ramp = INSERT * np.arange(n + band + 1)
            found[n, 1] = 0
            if self.last:
                found[n, 1 : band + 2] = ramp[: band + 1]
            for i in range(n - 1, -1, -1):
                low, high = max(0, n - i - band), n - i + band + 1
                high = min(high, n + band + 1)
                changed = self.extra[i] + REROLE * (letters[low:high] != self.kinds[i])
                best = np.minimum(found[i + 1, low + 1 : high + 1] + DELETE, found[i + 1, low:high] + changed)
                found[i, low + 1 : high + 1] = np.minimum.accumulate(best - ramp[low:high]) + ramp[low:high]
            self.tables[end] = found
        return self.tables[end]

    def _lengths(self, start: int, end: int) -> list[tuple[int, int, bool]]:
        """(cost, letters left, whether an ``s`` comes first) of each feasible length."""
        if end in (EMPTY, SYSTEM):
            found = [(DELETE * self.n, 0, False)] if start == end else []
            if (start, end) == (EMPTY, SYSTEM):
                found += [(int(DELETE * (self.n - 1) + self.extra[i]), 0, True) for i in np.flatnonzero(self.kinds == LETTERS["s"])]
            return found
        table = self.table(end)
        found = [(int(c), r, False) for r, c in enumerate(table[0, 1:]) if c < FAR and self._fits(start, end, r)]
        if start == EMPTY:
            for r in range(1, table.shape[1] - 1):
                if self._fits(SYSTEM, end, r) and (options := self._openings(table, r)):
                    found.append((min(options)[0], r, True))
        return found

    def _openings(self, table: np.ndarray, left: int) -> list[tuple[int, int]]:
        """(cost, turn) of each ``s`` that may stay first."""
        return [
            (int(DELETE * i + self.extra[i] + table[i + 1, left + 1]), int(i))
            for i in np.flatnonzero(self.kinds == LETTERS["s"])
            if table[i + 1, left + 1] < FAR
        ]

    def costs(self) -> list[int]:
        """Sixteen costs, by start and end."""
        return [min((c for c, *_ in self._lengths(p, q)), default=FAR) + self.forced for p in range(4) for q in range(4)]

    def walk(self, start: int, beyond: tuple[int, ...]) -> Walk:
        """The cheapest edits from ``start``, if ``beyond`` is what each end costs afterwards; of equal ones the least audit."""
        ways = [(c + beyond[q], c, q, r, s) for q in range(4) if beyond[q] < FAR for c, r, s in self._lengths(start, q)]
        least = min(ways)[0]
        traced = [(self._trace(q, r, s, c), c, q) for total, c, q, r, s in ways if total == least]
        edits, cost, end = min(traced, key=lambda x: audit_of(x[0]))
        free, tail = iter(edits), edits[self.n :]
        whole = tuple("D" if c == "x" else next(free) for c in self.codes) + tuple(tail)
        return Walk(cost + self.forced, end, whole)

    def _trace(self, end: int, left: int, opened: bool, cost: int) -> tuple[str, ...]:
        i, edits = 0, []
        if end in (EMPTY, SYSTEM):
            if opened:  # the last that may stay: deletions come first in the audit
                i = max(int(k) for k in np.flatnonzero(self.kinds == LETTERS["s"]) if DELETE * (self.n - 1) + self.extra[k] == cost)
                edits = ["D"] * i + ["K"]
                i += 1
            return (*edits, *["D"] * (self.n - i))
        table, letters = self.table(end), self._letters(end)
        if opened:
            i = max(k for c, k in self._openings(table, left) if c == cost)
            edits = ["D"] * i + ["K"]
            i += 1
        added = ""
        while i < self.n or left:
            here = table[i, left + 1]
            if i < self.n and here == table[i + 1, left + 1] + DELETE:
                own, i = "D", i + 1
            elif left and here == table[i, left] + INSERT:
                added += "ua"[letters[left]]
                left -= 1
                continue
            else:
                own = "K" if letters[left] == self.kinds[i] else "UA"[letters[left]]
                i, left = i + 1, left - 1
            edits.append(added + own)
            added = ""
        return (*edits, added) if added else tuple(edits)


@lru_cache(REMEMBERED)
def costs(codes: str, last: bool) -> list[int]:
    return Segment(codes, last).costs()


@lru_cache(REMEMBERED)
def walk(codes: str, last: bool, start: int, beyond: tuple[int, ...]) -> Walk:
    return Segment(codes, last).walk(start, beyond)
