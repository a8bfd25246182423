"""Dense observed graphs: counted on bitmaps, never by listing paths."""

from __future__ import annotations

import numpy as np
import pytest

from netmoment.operators import bitmaps, observed


def dense_graph(spark, n, p, seed, parts=((0.0, 1.0),)):
    """A random graph of parts of the nodes that are not linked with each other; ids are not places."""
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < p, 1)
    part = np.searchsorted([high for _, high in parts], np.arange(n) / n, side="right")
    a &= part[:, None] == part[None]
    pairs = [(int(i) * 7 + 3, int(j) * 7 + 3) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.range(n).selectExpr("id * 7 + 3 AS id"), spark.createDataFrame(pairs, "src long, dst long"), (a | a.T).astype(np.int64)


def census_of(a):
    k, c = a.sum(1), a @ a
    t = (c * a).sum(1) // 2
    m, mm = a @ k, a @ (a @ k)
    q0 = np.zeros(len(a), dtype=np.int64)
    for i in range(len(a)):
        for j in np.flatnonzero((a[i] == 0) & (np.arange(len(a)) != i)):
            both = np.flatnonzero(a[i] & a[j])
            q0[i] += len(both) * (len(both) - 1) // 2 - a[np.ix_(both, both)].sum() // 2
    return np.stack([t, k * (k - 1), m - k, q0, (k - 1) * (m - k) - 2 * t, mm - k * k - m + k - 2 * t], axis=1)


def refuse(*_args, **_options):
    raise AssertionError("paths are listed")


@pytest.fixture
def no_paths(monkeypatch):
    for name in ("triangles", "chordless_squares", "path_lengths", "neighbourhood_function"):
        monkeypatch.setattr(observed, name, refuse)


def test_census_of_a_dense_graph(spark, no_paths, monkeypatch):
    """Of a last stripe that is not full, and of unpacked columns that are cut."""
    monkeypatch.setattr(bitmaps, "COLUMNS", 64)
    monkeypatch.setattr(bitmaps, "CELLS", 150 * 56)
    ids, edges, a = dense_graph(spark, 150, 0.25, 1)
    got = observed.census(ids, edges).orderBy("id").toPandas()[list(observed.CENSUS)].to_numpy()
    want = census_of(a)
    np.testing.assert_array_equal(got, want)
    closed = observed.coefficients(ids, edges, ("tclust",)).orderBy("id").toPandas().tclust
    np.testing.assert_allclose(closed, 2 * want[:, 0] / want[:, 1])


@pytest.mark.parametrize(("p", "parts"), [(0.3, ((0.0, 1.0),)), (0.12, ((0.0, 0.4), (0.4, 0.98), (0.98, 1.0)))])
def test_path_lengths_of_a_dense_graph(spark, no_paths, p, parts):
    """Also of parts that are not linked, and nodes without edges."""
    ids, edges, a = dense_graph(spark, 140, p, 2, parts)
    d, reached, last = a.astype(float), (a > 0) | np.eye(len(a), dtype=bool), a > 0
    for step in range(2, 12):
        last = (last @ a > 0) & ~reached
        d[last], reached = step, reached | last
    want = d[d > 0].mean()
    assert d.max() >= 2
    assert observed.average_path_length(ids, edges).first()[0] == pytest.approx(want)
    assert observed.average_path_length(ids, edges, 8).first()[0] == pytest.approx(want, abs=1e-9)  # sketches of so few cells would be off


def test_sparse_graphs_and_loose_ends(spark):
    ids, edges, _ = dense_graph(spark, 140, 0.005, 3)
    assert bitmaps.pack(ids, edges) is None and bitmaps.pack(ids.limit(0), edges.limit(0)) is None
    with pytest.raises(Exception, match="an edge ends at no node"):
        bitmaps.pack(ids.where("id > 3"), dense_graph(spark, 140, 0.3, 3)[1])
