"""Draws and sums for which few points stand in place of all nodes, against all nodes."""

import numpy as np
import pytest

from netmoment.operators import kernels, lines


@pytest.mark.parametrize("n", [4097, 5 * 1024, 9000])
def test_draws_and_sums_are_those_of_all_nodes(n):
    """The same neighbours are drawn, and all motifs are the same, for the first and last node and others; most work does not grow with the nodes."""
    rng = np.random.default_rng(n)
    mu = rng.uniform(-2.2, 0.3, n)
    d = np.array([lines.sigmoid(m + mu).sum() - lines.sigmoid(2 * m) for m in mu])
    pieces = lines.pieces_of(mu.min(), mu.max(), n)
    line = lines.Line(mu, pieces, d)
    assert len(line.x) < 100 and line.whole.sum() == pytest.approx(n)
    for at in (0, n - 1, 255, 256, *rng.integers(0, n, 6).tolist()):
        want, got = kernels._Draws(mu, d, at, 7, (3, at, 0)), kernels._LineDraws(line, d, at, 7, (3, at, 0))
        np.testing.assert_array_equal(got.j, want.j)
        for name in ("triangle", "twedge", "thead", "quadrangle", "qwedge", "qhead"):
            assert getattr(got, name)() == pytest.approx(getattr(want, name)(), rel=1e-11)


def test_where_points_cannot_stand_for_nodes():
    assert lines.pieces_of(-2.0, 0.0, lines.LEAST) is None  # few nodes
    assert lines.pieces_of(-20.0, 0.0, 10**6) is None  # chances so small that rounding counts
    assert lines.pieces_of(-2.0, float("inf"), 10**6) is None and lines.pieces_of(float("nan"), 0.0, 10**6) is None
    flat = lines.Line(np.full(5000, -1.0), lines.pieces_of(-1.0, -1.0, 5000))
    total, at, p = flat.drawn(lambda x: lines.sigmoid(x - 1), [0, 4999], np.array([0.0, 0.50001, 1 - 1e-16]))
    assert total == pytest.approx(4998 * lines.sigmoid(-2.0)) and at.tolist() == [1, 2500, 4998] and p == pytest.approx(lines.sigmoid(-2.0))
