"""Draws of nodes in proportion to products of edge probabilities, and sums of these over all nodes, without a term for each node.

A product f of sigmoids of mu + mu_j is smooth in mu_j, so a few Chebyshev points with weights stand for all nodes in its sum (see interpolation), and other weights
for the nodes of each run of BLOCK of them in order of id.  A draw finds its run in the cumulated sums of these, and its node in the run's own
terms, which are exact: points times n / BLOCK multiplications for a line, and BLOCK terms for a draw.  The error is below ERROR of the least term that f may have, for each node summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import interpolation

#: Nodes in a run; with at most LEAST nodes in all, lines of all of them are little work.
BLOCK, LEAST = 256, 4096
#: The error of a term, as a part of the least p * (1 - p), and what that has to be at least for it to stand out from rounding.
ERROR, LEAST_TERM = 1e-13, 1e-3


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of numbers in the ranges that lines are for, which do not overflow."""
    return 1 / (1 + np.exp(-x))


def pieces_of(low: float, high: float, n: int) -> interpolation.Pieces | None:
    """The pieces of n nodes' lines, if there are many nodes and the range of mu, from low to high, allows it."""
    if n <= LEAST or not math.isfinite(low + high) or max(-low, high) > 300:
        return None
    least = float(sigmoid(np.array(2 * low)) * sigmoid(np.array(-2 * high)))
    if least < LEAST_TERM:
        return None
    try:
        pieces = interpolation.pieces_of(low, high, n, 1.0, ERROR * least * n)
    except ValueError:
        return None
    return pieces if pieces.count * (pieces.degree + 1) <= interpolation.MOST_POINTS else None


class Line:
    """Points x that stand for nodes of parameters mu, in order of id; upto: their weights for all nodes up to the end of each run; heads: weights for sums over nodes times d."""

    def __init__(self, mu: np.ndarray, pieces: interpolation.Pieces, d: np.ndarray | None = None):
        m, count = pieces.degree, pieces.count
        self.mu = mu
        q, angle = np.arange(m + 1), (np.arange(m + 1) + 0.5) * (math.pi / (m + 1))
        basis = np.cos(np.outer(q, angle)) * np.where(q == 0, 1.0, 2.0)[:, None] / (m + 1)
        self.x = (pieces.low + (2 * np.arange(count)[:, None] + 1) * pieces.half + pieces.half * np.cos(angle)).ravel()
        runs = -(-len(mu) // BLOCK)
        weights, heads = np.empty((runs, len(self.x))), np.zeros((count, m + 1))
        step = 64
        for a in range(0, runs, step):
            own = mu[a * BLOCK : (a + step) * BLOCK]
            piece = np.clip(np.floor((own - pieces.low) / (2 * pieces.half)), 0, count - 1).astype(np.int64)
            turn = np.arccos(np.clip((own - pieces.low - (2 * piece + 1) * pieces.half) / pieces.half, -1, 1))
            size = min(step, runs - a)
            place = np.arange(len(own)) // BLOCK * count + piece
            cosines = [np.cos(k * turn) for k in q]
            moments = np.stack([np.bincount(place, c, size * count) for c in cosines], axis=1)
            weights[a : a + size] = (moments @ basis).reshape(size, -1)
            if d is not None:
                heads += np.stack([np.bincount(piece, c * d[a * BLOCK : (a + step) * BLOCK], count) for c in cosines], axis=1)
        self.upto = np.cumsum(weights, axis=0)
        self.heads = (heads @ basis).ravel()

    @property
    def whole(self) -> np.ndarray:
        """Weights for sums over all nodes."""
        return self.upto[-1]

    def drawn(self, f: Callable[[np.ndarray], np.ndarray], without: list[int], u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The sum of f(mu) over all nodes but those at some places, and for each number from 0 to 1 the place of the node whose part of the line it falls into, and that one's f."""
        ends, without = self.upto @ f(self.x), np.array(sorted(set(without)), dtype=np.int64)
        for at, value in zip(without.tolist(), f(self.mu[without]).tolist(), strict=True):
            ends[at // BLOCK :] -= value
        goal = u * ends[-1]
        run = np.minimum(np.searchsorted(ends, goal, side="right"), len(ends) - 1)
        goal = goal - np.where(run > 0, ends[run - 1], 0.0)
        first = run * BLOCK
        places = np.minimum(first[:, None] + np.arange(BLOCK), len(self.mu) - 1)
        terms = f(self.mu[places])
        if (past := int(first.max()) + BLOCK - len(self.mu)) > 0:
            terms[first == first.max(), -past:] = 0
        for at in without.tolist():
            here = first == at // BLOCK * BLOCK
            terms[here, at % BLOCK] = 0
        sums = np.cumsum(terms, axis=1)
        # a goal beyond the run's sum, by rounding, is in the last part
        last = BLOCK - 1 - np.argmax(terms[:, ::-1] > 0, axis=1)
        inside = np.minimum((sums <= goal[:, None]).sum(1), last)
        rows = np.arange(len(u))
        # a part that is empty ends where the one before does, so none is met but at the very start of a run
        inside = np.where(terms[rows, inside] > 0, inside, np.argmax(terms > 0, axis=1))
        return float(ends[-1]), first + inside, terms[rows, inside]
