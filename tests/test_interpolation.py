"""Interpolated sums within their bounds, and fits by distributed steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.functions import expr as E
from netmoment.operators import fit, geometry, interpolation, observed, stats
from netmoment.plans.model import Ensemble


def model(spark, n, low, high):
    return Ensemble.heterogeneous(spark.range(n).select("id", (E.hash_uniform(4, F.col("id")) * (high - low) + low).alias("mu")))


def frame(df, name):
    return df.select("id", name).orderBy("id").toPandas()[name].to_numpy()


@pytest.mark.parametrize(("low", "high"), [(-3.0, -1.0), (-12.0, 9.0), (2.0, 2.0)])
@pytest.mark.parametrize("tolerance", [1e-3, 1e-9])
def test_within_the_bound(spark, low, high, tolerance):
    m = model(spark, 300, low, high)
    got = stats.degree(m.nodes, tolerance=tolerance)
    bound = got.schema["degree"].metadata["error_bound"]
    assert 0 < bound <= tolerance
    rounding = 300 * 1e-14
    assert np.abs(frame(got, "degree") - frame(stats.degree(m.nodes), "degree")).max() <= bound + rounding
    got = stats.node_free_energy(m.nodes, tolerance=tolerance)
    assert got.schema["free_energy"].metadata["error_bound"] <= tolerance
    assert np.abs(frame(got, "free_energy") - frame(stats.node_free_energy(m.nodes), "free_energy")).max() <= tolerance + rounding * 10
    sums, _ = interpolation.node_sums(m, m.all_nodes, tolerance)
    want = stats.node_sums(m, m.all_nodes)
    for c, most in (("d", tolerance), ("s", tolerance), ("m", tolerance * 600)):
        assert np.abs(frame(sums, c) - frame(want, c)).max() <= most + 300 * rounding


def test_the_bound_holds_for_the_worst_term():
    """Interpolation of one sigmoid and one ln(1 + exp(x)) against their values, wherever the piece lies."""
    x = np.linspace(-1, 1, 2001)
    for half in (0.5, 1.5):
        for degree in (4, 8, 16):
            bounds = [interpolation.error_bound(half, degree, most, 1) for most in (1.0, 10 + math.log(2) + math.pi)]
            for middle in (-6.0, -1.0, 0.0, 0.3, 5.0):
                for f, bound in zip((lambda v: 1 / (1 + np.exp(-v)), lambda v: np.log1p(np.exp(v))), bounds, strict=True):
                    p = np.polynomial.chebyshev.Chebyshev.interpolate(lambda t, f=f, m=middle, h=half: f(m + h * t), degree)
                    assert np.abs(p(x) - f(middle + half * x)).max() <= bound


def test_few_points_for_many_nodes(spark):
    m = model(spark, 3000, -4.0, 0.0)
    pieces = interpolation.plan(m, ("p",), 1e-8)
    assert pieces.count * (pieces.degree + 1) < 100 and pieces.bound <= 1e-8
    some = stats.degree(m.nodes[[7, 5, 7]], tolerance=1e-8).orderBy("pos").toPandas()
    want = stats.degree(m.nodes[[7, 5, 7]]).orderBy("pos").toPandas()
    assert some.id.tolist() == [7, 5, 7] and np.allclose(some.degree, want.degree, atol=1e-8)
    for f in (stats.edge_count, stats.edge_density, stats.free_energy, stats.log_partition):
        assert f(m, tolerance=1e-9).first()[0] == pytest.approx(f(m).first()[0], abs=3000 * 1e-9)
    with pytest.raises(ValueError, match="tolerance"):
        stats.degree(m.nodes, tolerance=0.0)


def random_graph(spark, n, p, seed):
    rng = np.random.default_rng(seed)
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < p
    pairs = list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))
    return spark.range(n), spark.createDataFrame(pairs, "src long, dst long")


def test_published_heterogeneous_fit(spark):
    """1000 nodes, p = 10 / n, starting from zeros: expected degrees near the observed ones, by distributed steps alone."""
    ids, edges = random_graph(spark, 1000, 0.01, 303)
    found, solution = fit.fit_degrees(ids, edges, start="zeros", newton_classes=1)
    assert solution.converged and solution.iterations <= 128
    both = fit.expectations(found, ids).join(observed.degree(ids, edges).withColumnRenamed("degree", "k"), "id").toPandas()
    np.testing.assert_allclose(both.degree, both.k, rtol=1e-3, atol=5e-2)


def test_steps_of_uneven_degrees(spark):
    """A star with a tail and a dense core: a few steps, the same answer as Newton's."""
    edges = [(0, i) for i in range(1, 60)] + [(i, j) for i in range(1, 12) for j in range(i + 1, 12)] + [(60, 59), (60, 61)]
    ids, edges = spark.range(64), spark.createDataFrame(edges, "src long, dst long")
    want, _ = fit.fit_degrees(ids, edges)
    got, solution = fit.fit_degrees(ids, edges, newton_classes=1)
    assert solution.converged and solution.iterations < 60
    both = got.where("mu is not null").join(want.withColumnRenamed("mu", "other"), "id").toPandas()
    assert len(both) == 62
    np.testing.assert_allclose(both.mu, both.other, atol=1e-4)


def test_the_minimum_is_the_likelihoods():
    """minimized() on plain sums: the gradient vanishes and no neighbour is better."""
    k, w = np.array([1.0, 2.0, 5.0, 9.0]), np.array([40.0, 30.0, 12.0, 3.0])

    def sums(mu):
        x = mu[:, None] + mu[None]
        p, f = 1 / (1 + np.exp(-x)), np.logaddexp(0, x)
        return float(w @ (f @ w - np.diag(f))) / 2, p @ w - np.diag(p)

    mu, steps, error = fit.minimized(sums, k, w, np.zeros(4), 1e-9, 100)
    assert error <= 1e-9 and steps < 40
    value = lambda m: sums(m)[0] - float(w @ (k * m))
    for i in range(4):
        for d in (-0.01, 0.01):
            assert value(mu) < value(mu + d * np.eye(4)[i])


def test_geometric_integrals_are_interpolated(spark):
    nodes = spark.range(60).select("id", (F.col("id") % 50 / 20 - 1.2).alias("mu"))
    for layers in ([geometry.Layer("similarity")], [geometry.Layer("similarity", beta=0.7), geometry.Layer("complementarity", modified=False, log=False)]):
        m = geometry.GeometricModel.of(60, 2, *layers)
        want = frame(m.expected_degree(spark, 32, nodes), "degree")
        for tolerance in (1e-3, 1e-10):
            assert np.abs(frame(m.expected_degree(spark, 32, nodes, tolerance), "degree") - want).max() <= tolerance + 1e-11
    with pytest.raises(ValueError, match="steps"):
        geometry.GeometricModel.of(60, 2, geometry.Layer(beta=math.inf)).expected_degree(spark, 8, nodes, 1e-3)


def test_gradients_are_differences(spark):
    """The derivative of each sum by each of a few mu, against a small step of that mu."""
    mu = {0: -1.0, 2: 0.5, 5: -1.0, 7: 0.25, 9: 1.5, 11: -1.0, 12: 0.5, 20: -2.0}
    of = lambda m: Ensemble.heterogeneous(spark.createDataFrame(sorted(m.items()), "id long, mu double"))

    def total(m, name):
        p = np.array([[0 if i == j else 1 / (1 + math.exp(-a - b)) for j, b in m.items()] for i, a in m.items()])
        return {"degree": p.sum(), "triangle": np.trace(p @ p @ p) / 2, "twedge": (p.sum(1) ** 2 - (p * p).sum(1)).sum()}["twedge" if name == "thead" else name]

    for name in ("degree", "twedge", "thead", "triangle"):
        got = {r.id: r.gradient for r in stats.motif_gradient(of(mu).nodes, name).collect()}
        assert set(got) == set(mu)
        for i in mu:
            up, down = (total({**mu, i: mu[i] + h}, name) for h in (1e-5, -1e-5))
            assert got[i] == pytest.approx((up - down) / 2e-5, rel=1e-6), (name, i)
    some = stats.motif_gradient(of(mu).nodes[[9, 2, 9]], "triangle", normalize=True).orderBy("pos").collect()
    assert [r.id for r in some] == [9, 2, 9] and some[0].gradient == pytest.approx(got[9] / 8)
    flat = stats.motif_gradient(Ensemble.homogeneous(spark, 5, -0.5).nodes, "degree").collect()
    p = 1 / (1 + math.exp(0.5))
    assert len(flat) == 5 and flat[0].gradient == pytest.approx(8 * p * (1 - p))
    with pytest.raises(NotImplementedError):
        stats.motif_gradient(of(mu).nodes, "quadrangle")


def test_path_lengths_by_sketches(spark):
    ids, edges = spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "src long, dst long")
    assert observed.neighbourhood_function(ids, edges) == [6, 14, 18, 20]
    assert observed.average_path_length(ids, edges, 12).first()[0] == pytest.approx(observed.average_path_length(ids, edges).first()[0])
    assert observed.average_path_length(ids, edges.limit(0), 12).first()[0] is None
    ids, edges = random_graph(spark, 700, 0.006, 5)
    got = observed.average_path_length(ids, edges, 10)
    error = got.schema["average_path_length"].metadata["relative_error"]
    assert error == pytest.approx(0.0325) and got.first()[0] == pytest.approx(observed.average_path_length(ids, edges).first()[0], rel=error)


def test_many_classes_are_interpolated(spark, monkeypatch):
    """Beyond MANY_CLASSES exact sums are no longer of all pairs of classes, and the same to far below 6 decimals; ranges that can't be interpolated stay exact."""
    rows = spark.range(300).select("id", (F.sin("id") * 1.5 - 1).alias("mu"))
    model = Ensemble.heterogeneous(rows)
    of = lambda: [sorted((r.id, r[-1]) for r in f.collect()) for f in (stats.degree(model.nodes), stats.motifs(model.nodes, ("thead",), mc=False), stats.node_free_energy(model.nodes), stats.motif_gradient(model.nodes, "degree"))]
    exact = of()
    monkeypatch.setattr(stats, "MANY_CLASSES", 20)
    got = of()
    for a, b in zip(exact, got, strict=True):
        assert [x[0] for x in a] == [x[0] for x in b]
        assert max(abs(x[1] - y[1]) for x, y in zip(a, b, strict=True)) < 2e-9
    assert stats.degree(model.nodes).schema["degree"].metadata["error_bound"] <= stats.TOLERANCE
    wide = Ensemble.heterogeneous(rows.withColumn("mu", F.when(F.col("id") == 7, float("-inf")).otherwise(F.col("mu"))))
    assert not stats._many(wide, ("p", "p2"), stats.TOLERANCE)


def test_triangles_of_many_classes(spark, monkeypatch):
    """Few points stand for all nodes, repeated parameters included, to far below 6 decimals."""
    rows = spark.range(240).select("id", F.when(F.col("id") % 5 == 0, F.lit(-0.4)).otherwise(F.sin("id") * 1.2 - 1).alias("mu"))
    m = Ensemble.heterogeneous(rows)
    exact = frame(stats.motifs(m.nodes, ("triangle",), mc=False), "triangle")
    monkeypatch.setattr(stats, "MANY_CLASSES", 20)
    monkeypatch.setattr(stats.kernels, "exact", None)
    monkeypatch.setattr(stats.classes, "exact", None)
    assert np.abs(frame(stats.motifs(m.nodes, ("triangle",), mc=False), "triangle") - exact).max() < 1e-8
    assert np.abs(frame(stats.coefficients(m.nodes[:9], ("tclust",), mc=False), "tclust")).max() < 1


def test_squares_of_many_classes(spark, monkeypatch):
    rows = spark.range(60).select("id", F.when(F.col("id") % 5 == 0, F.lit(-0.4)).otherwise(F.sin("id") * 1.2 - 1).alias("mu"))
    m, names = Ensemble.heterogeneous(rows), ("triangle", "quadrangle", "qwedge", "qhead")
    exact = stats.motifs(m.nodes, names, mc=False).orderBy("id").toPandas()
    monkeypatch.setattr(stats, "MANY_CLASSES", 20)
    monkeypatch.setattr(stats.kernels, "exact", None)
    monkeypatch.setattr(stats.classes, "exact", None)
    got = stats.motifs(m.nodes, names, mc=False).orderBy("id").toPandas()
    for n in names:
        assert np.abs(got[n] - exact[n]).max() < 1e-8, n
