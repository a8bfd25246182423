"""Local alignment of word hashes, for finding edited copies of short texts in long ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class Alignment:
    """The best local alignment: its score, the words that match, and half-open spans in both texts."""

    score: int
    matches: int
    start: int
    end: int
    other_start: int
    other_end: int


def smith_waterman(a: np.ndarray, b: np.ndarray, centre: int | None = None, band: int | None = None) -> Alignment:
    """Of a (rows) and b (columns); with band, only cells within it of the diagonal where b's place is a's plus centre.

    Gaps are linear, so a row's gaps are a running maximum and each row is a few array operations.  A cell keeps where its
    alignment began and how many words match, so that two rows are held, of all columns or of the band's 2 * band + 1.  Among equal scores the
    earliest end in a, then in b, is taken.
    """
    n, m = len(a), len(b)
    best = Alignment(0, 0, 0, 0, 0, 0)
    if not n or not m:
        return best
    banded = band is not None
    size = 2 * band + 1 if banded else m
    first = (centre or 0) - band if banded else 0  # the column of the first cell
    places = np.arange(size)
    ramp = -GAP * places
    # of the row before: scores, matches, and begins in a and b; a cell more on the side where a row lacks one
    score, matches, top, left = (np.zeros(size + 1, dtype=np.int64) for _ in range(4))
    # a band moves on by one column a row, so its rows are shifted; either way these are the cells before
    diagonal, above = slice(0, size), slice(1, size + 1)
    for i in range(n):
        column = places + first + (i if banded else 0)
        inside = (column >= 0) & (column < m)
        if not inside.any():
            score[:] = 0
            continue
        same = (b[np.clip(column, 0, m - 1)] == a[i]) & inside
        fresh = score[diagonal] == 0
        by_diagonal = score[diagonal] + np.where(same, MATCH, MISMATCH)
        by_above = score[above] + GAP
        down = by_above > by_diagonal
        own = np.where(down, by_above, by_diagonal)
        live = (own > 0) & inside
        own = np.where(live, own, 0)
        m_own = np.where(down, matches[above], np.where(fresh, 0, matches[diagonal]) + same)
        t_own = np.where(down, top[above], np.where(fresh, i, top[diagonal]))
        l_own = np.where(down, left[above], np.where(fresh, column, left[diagonal]))
        most = np.maximum.accumulate(own + ramp)
        origin = np.maximum.accumulate(np.where(own + ramp == most, places, 0))
        now = np.where(inside, most - ramp, 0)
        at = slice(0, size) if banded else slice(1, size + 1)
        score[at], matches[at], top[at], left[at] = now, m_own[origin], t_own[origin], l_own[origin]
        score[size if banded else 0] = 0
        k = int(now.argmax())
        if now[k] > best.score:
            best = Alignment(int(now[k]), int(matches[at][k]), int(top[at][k]), i + 1, int(left[at][k]), int(column[k]) + 1)
    return best


def clusters(diagonals: np.ndarray, reach: int) -> list[np.ndarray]:
    """Indices of diagonals in runs, sorted, whose neighbours are at most reach apart."""
    order = np.argsort(diagonals, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(diagonals[order]) > reach) + 1) if len(order) else []
