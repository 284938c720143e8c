"""Structural joins over the nodes of whole pages, as array operations.

Nodes of some pages stand in document order, so a subtree is a run of rows: a node's row and all up to ``end``. What lies inside
a node is found by two binary searches in the rows that pass a test, children by one in their parents. Nothing is
compared with its ancestors one by one, and no pair is made that does not belong to the result.

A place is a row, or -1 - p for the page p as a whole. A node set is a pair of arrays, context and place, ordered by
both and without repeats; contexts are numbered in the order of their pages.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np

from folioflow.functions.text import SPACE_CHARS

#: Larger than any row number of a chunk.
FAR = 1 << 40
TEXT_BLANKS, LINE_BLANKS = "\t\n\r\f\x0b\u00a0\u3000", "\t\r\n\f\x0b"
_RUNS = re.compile(" {2,}")
_BLANK = {chars: str.maketrans(chars, " " * len(chars)) for chars in (TEXT_BLANKS, LINE_BLANKS)}


def collapsed(s: str, blanks: str = TEXT_BLANKS) -> str:
    """Runs of the given characters and blanks as one blank, none at the ends."""
    s = s.translate(_BLANK[blanks])
    return (_RUNS.sub(" ", s) if "  " in s else s).strip(SPACE_CHARS)


class NodeSet(NamedTuple):
    ctx: np.ndarray
    at: np.ndarray

    def only(self, keep: np.ndarray) -> NodeSet:
        return NodeSet(self.ctx[keep], self.at[keep])

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each entry its number inside its context, from 0, and the size of its context."""
        if not len(self.ctx):
            return self.ctx, self.ctx
        new = np.flatnonzero(np.concatenate([[True], self.ctx[1:] != self.ctx[:-1]]))
        size = np.diff(np.append(new, len(self.ctx)))
        return np.arange(len(self.ctx)) - np.repeat(new, size), np.repeat(size, size)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and which range each is of."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which], which


class Pages:
    """Rows of whole pages in document order, by columns.

    ``page`` changes where a new page starts; ``pre`` counts from 1 in each page; ``last``, ``parent`` and ``prev`` are numbers
    like ``pre``, 0 where there is none.
    """

    def __init__(self, page: np.ndarray, pre: np.ndarray, last: np.ndarray, parent: np.ndarray, prev: np.ndarray):
        n = len(page)
        self.first = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])) if n else np.zeros(0, np.int64)
        self.stop = np.append(self.first[1:], n)  # one past the last row of each page
        self.page_no = np.repeat(np.arange(len(self.first)), self.stop - self.first)
        base = self.first[self.page_no] - 1
        if (pre != np.arange(n) - base).any():
            raise ValueError("nodes of a page must be whole and page ids must not repeat")
        self.end = base + last
        self.up = np.where(parent > 0, base + parent, -1 - self.page_no)
        self.prev = np.where(prev > 0, base + prev, -FAR)
        self.base = base

    # Places ---------------------------------------------------------------------------

    def roots(self) -> NodeSet:
        """Every page as its own context."""
        pages = np.arange(len(self.first))
        return NodeSet(pages, -1 - pages)

    def page_of(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, -1 - at, self.page_no[np.maximum(at, 0)])

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row before what is inside a place, and its last row."""
        page = self.page_of(at)
        return np.where(at < 0, self.first[page] - 1, at), np.where(at < 0, self.stop[page] - 1, self.end[np.maximum(at, 0)])

    # Axes -----------------------------------------------------------------------------

    def inside(self, s: NodeSet, rows: np.ndarray, with_self: bool = False) -> NodeSet:
        """Those of ``rows`` below the places of each context. Places below other ones add nothing and are passed over."""
        low, high = self.bounds(s.at)
        if len(s.at):
            reached = np.maximum.accumulate(s.ctx * FAR + high)
            outer = np.concatenate([[True], s.ctx[1:] * FAR + low[1:] > reached[:-1]])
            s, low, high = s.only(outer), low[outer], high[outer]
        start = np.searchsorted(rows, low + ((s.at < 0) | (not with_self)), "left")
        which, of = _spread(start, np.searchsorted(rows, high, "right"))
        return NodeSet(s.ctx[of], rows[which])

    def _by(self, s: NodeSet, rows: np.ndarray, link: np.ndarray) -> NodeSet:
        """Those of ``rows`` whose ``link`` is a place of the set."""
        order = np.argsort(link[rows], kind="stable")
        links = link[rows][order]
        which, of = _spread(np.searchsorted(links, s.at, "left"), np.searchsorted(links, s.at, "right"))
        return self._ordered(s.ctx[of], rows[order][which])

    def child(self, s: NodeSet, rows: np.ndarray) -> NodeSet:
        return self._by(s, rows, self.up)

    def next(self, s: NodeSet, rows: np.ndarray) -> NodeSet:
        return self._by(s, rows, self.prev)

    def later(self, s: NodeSet, rows: np.ndarray) -> NodeSet:
        """Siblings behind a place: the first place among siblings decides for all that follow."""
        s = s.only(s.at >= 0)
        up = self.up[s.at]
        order = np.lexsort((s.at, up, s.ctx))
        ctx, up, at = s.ctx[order], up[order], s.at[order]
        firsts = np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (up[1:] != up[:-1])]) if len(ctx) else np.zeros(0, bool)
        ctx, up, at = ctx[firsts], up[firsts], at[firsts]
        key = self.up[rows] * FAR + rows
        by = np.argsort(key, kind="stable")
        which, of = _spread(np.searchsorted(key[by], up * FAR + at, "right"), np.searchsorted(key[by], up * FAR + (FAR - 1), "right"))
        return self._ordered(ctx[of], rows[by][which])

    def _ordered(self, ctx: np.ndarray, at: np.ndarray) -> NodeSet:
        order = np.lexsort((at, ctx))
        return NodeSet(ctx[order], at[order])

    # Filters --------------------------------------------------------------------------

    def holds(self, s: NodeSet, rows: np.ndarray) -> np.ndarray:
        """Which places have one of ``rows`` inside."""
        low, high = self.bounds(s.at)
        return np.searchsorted(rows, high, "right") > np.searchsorted(rows, low, "right")

    def is_in(self, s: NodeSet, other: NodeSet) -> np.ndarray:
        """Which places are in the other set, whatever the context."""
        return np.isin(s.at, other.at)


def picked(s: NodeSet, op: str, n: int = 0, stop: int | None = None) -> NodeSet:
    """Set positions per context in document order: eq, not_eq, lt, gt, first, last, even, odd, or slice from ``n`` to ``stop``.

    Negative numbers count from the end; a slice with two descending negative bounds goes from the second to the end.
    """
    i, size = s.sizes()
    at = size + n if n < 0 else n
    if op == "slice":
        if stop is not None and stop < 0 and n < 0 and n > stop:
            n, stop = stop, None
        low = np.maximum(size + n, 0) if n < 0 else n
        high = size if stop is None else np.maximum(size + stop, 0) if stop < 0 else stop
        return s.only((i >= low) & (i < high))
    keep = {
        "eq": i == at,
        "not_eq": i != at,
        "lt": i < max(0, n),
        # From the second to last on for -2, and all for -1.
        "gt": i > n if n >= -1 else i >= size + n + 1,
        "first": i == 0,
        "last": i == size - 1,
        "even": i % 2 == 0,
        "odd": i % 2 == 1,
    }[op]
    return s.only(keep)


class Texts:
    """Texts of places, put together from the pieces of their rows."""

    def __init__(self, pages: Pages, rows: np.ndarray, text: list[str], gap: np.ndarray, hide: np.ndarray):
        """``rows`` hold text; ``gap`` tells whether an element ended before it; ``hide`` is the innermost row that hides it."""
        self.pages, self.rows, self.text, self.hide = pages, rows, text, hide
        self.spaced = [" " + t if g else t for t, g in zip(text, gap.tolist())]
        self.hidden = np.concatenate([[0], np.cumsum(hide >= 0)])

    def whole(self, at: np.ndarray) -> list[str]:
        """Visible text inside each place, element ends as blanks, blanks collapsed."""
        low, high = self.pages.bounds(at)
        start, stop = np.searchsorted(self.rows, low, "right"), np.searchsorted(self.rows, high, "right")
        plain = (self.hidden[stop] == self.hidden[start]).tolist()
        out = []
        for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
            pieces = self.spaced[a:b]
            if not plain[k]:
                pieces = [self.spaced[i] for i in range(a, b) if self.hide[i] < low[k] or self.hide[i] < 0]
            out.append(collapsed("".join(pieces)))
        return out

    def own(self, at: np.ndarray) -> list[str]:
        """Text that stands directly in each place."""
        return [collapsed("".join(self.text[i] for i in direct)) for direct in self.direct(at)]

    def direct(self, at: np.ndarray) -> list[np.ndarray]:
        """Numbers of the text rows that stand directly in each place."""
        up = self.pages.up[self.rows]
        order = np.argsort(up, kind="stable")
        start, stop = np.searchsorted(up[order], at, "left"), np.searchsorted(up[order], at, "right")
        return [order[a:b] for a, b in zip(start.tolist(), stop.tolist())]

    def lines(self, at: np.ndarray, elements: np.ndarray) -> list[str]:
        """One line for each direct text and each child element of a place."""
        own = self.direct(at)
        kids = self.pages.child(NodeSet(np.arange(len(at)), at), elements)
        values = [[(int(self.rows[i]), collapsed(self.text[i])) for i in direct] for direct in own]
        for k, row, text in zip(kids.ctx.tolist(), kids.at.tolist(), self.whole(kids.at)):
            values[k].append((row, text))
        return ["\n".join(t for _, t in sorted(v) if t) for v in values]


class Events:
    """Starts and ends of nodes in the order in which markup has them; those inside a node are a run."""

    def __init__(self, pages: Pages, depth: np.ndarray):
        n = len(pages.end)
        rows = np.arange(n)
        place = np.concatenate([rows, pages.end])
        # At one place the start comes first; of several ends the deepest comes first.
        order = np.lexsort((np.concatenate([np.zeros(n, np.int64), -depth]), np.repeat([0, 1], n), place))
        self.pages, self.row, self.ends = pages, order % max(n, 1), order >= n
        where = np.empty(2 * n, np.int64)
        where[order] = np.arange(2 * n)
        self.start, self.stop = where[:n], where[n:]

    def runs(self, at: np.ndarray, outer: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First event and one past the last event of each place."""
        page = self.pages.page_of(at)
        row = np.maximum(at, 0)
        # Before the first row of a page stand two events for each row of the pages before it.
        low = np.where(at < 0, 2 * self.pages.first[page], self.start[row] + (not outer))
        return low, np.where(at < 0, 2 * self.pages.stop[page], self.stop[row] + outer)

    def markup(self, at: np.ndarray, head: list[str], tail: list[str], outer: bool) -> list[str]:
        pieces = [tail[r] if e else head[r] for r, e in zip(self.row.tolist(), self.ends.tolist())]
        return ["".join(pieces[a:b]) for a, b in zip(*(x.tolist() for x in self.runs(at, outer)))]

    def lines(self, at: np.ndarray, s: list[str], cut: np.ndarray, skip: np.ndarray) -> list[list[tuple[int, str]]]:
        """Numbered lines of each place: a start or end of a node with ``cut`` ends a line, what a ``skip`` row below holds is left out."""
        low, _ = self.pages.bounds(at)
        out = []
        for k, (a, b) in enumerate(zip(*(x.tolist() for x in self.runs(at)))):
            rows, ends = self.row[a:b], self.ends[a:b]
            seen = (skip[rows] <= low[k]) & (cut[rows] | ~ends)
            rows, ends = rows[seen], ends[seen]
            line_no = np.cumsum(cut[rows])
            found: list[tuple[int, str]] = []
            parts: list[str] = []
            now = 0
            for row, no, end in zip(rows.tolist(), line_no.tolist(), ends.tolist()):
                if no != now:
                    if parts:
                        found.append((now, "".join(parts)))
                    parts, now = [], no
                if not end and s[row]:
                    parts.append(s[row])
            if parts:
                found.append((now, "".join(parts)))
            lines = ((no, collapsed(text, LINE_BLANKS)) for no, text in found)
            out.append([(no, line) for no, line in lines if line])
        return out

