"""Golden values, identities, views and edge cases of the ensemble model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.operators import stats
from netmoment.plans.model import Ensemble


def normal_model(spark, n, mean, seed=42, digits=None):
    mu = np.random.default_rng(seed).normal(size=n) + mean
    if digits is not None:
        mu = mu.round(digits)
    return Ensemble.heterogeneous(spark.createDataFrame([(i, float(x)) for i, x in enumerate(mu)], "id long, mu double")), mu


def p_matrix(mu):
    p = 1 / (1 + np.exp(-(mu[:, None] + mu[None])))
    np.fill_diagonal(p, 0)
    return p


def literal(mu):
    """Motif sums over distinct nodes by explicit loops over index tuples."""
    p, n = p_matrix(mu), len(mu)
    out = {k: np.zeros(n) for k in stats.TRIANGLE + stats.QUADRANGLE}
    for i in range(n):
        for j in range(n):
            for k in range(n):
                if len({i, j, k}) < 3:
                    continue
                out["triangle"][i] += p[i, j] * p[j, k] * p[i, k] / 2
                out["twedge"][i] += p[i, j] * p[i, k]
                out["thead"][i] += p[i, j] * p[j, k]
                for l in range(n):
                    if l in (i, j, k):
                        continue
                    out["quadrangle"][i] += p[i, j] * p[j, k] * (1 - p[i, k]) * p[k, l] * p[i, l] * (1 - p[j, l]) / 2
                    out["qwedge"][i] += p[i, j] * p[j, k] * p[i, l]
                    out["qhead"][i] += p[i, j] * p[j, k] * p[k, l]
    return out


def column(df, name):
    return df.orderBy("id").toPandas()[name].to_numpy()


@pytest.mark.parametrize(
    ("name", "value"),
    [("tclust", 0.11920292), ("tclosure", 0.11920292), ("similarity", 0.1192029), ("qclust", 0.0924780), ("qclosure", 0.0924780), ("complementarity", 0.0924780)],
)
def test_golden_coefficients(spark, name, value):
    assert stats.coefficients(Ensemble.homogeneous(spark, 100, -2).nodes, (name,)).first()[name] == pytest.approx(value, abs=1e-6)


def test_golden_degree_and_probability(spark):
    m = Ensemble.homogeneous(spark, 100, -2)
    assert stats.degree(m.nodes).first().degree == pytest.approx(11.801089, abs=1e-6)
    assert m.pairs[0, 1].probs().first().p == pytest.approx(0.11920293, abs=1e-7)


@pytest.mark.parametrize("digits", [None, 0])
def test_motifs_are_the_literal_sums(spark, digits):
    m, mu = normal_model(spark, 8, -0.5, digits=digits)
    want = literal(mu)
    got = stats.motifs(m.nodes)
    for k, v in want.items():
        np.testing.assert_allclose(column(got, k), v, rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_nodes(spark, n):
    m, mu = normal_model(spark, n, 0.0)
    want = literal(mu)
    got = stats.motifs(m.nodes)
    for k, v in want.items():
        np.testing.assert_allclose(column(got, k), v, atol=1e-12)
    assert stats.tstats(m.nodes).toPandas().tclust.isna().all() == (n < 3)
    assert stats.qstats(m.nodes).toPandas().qclust.isna().all()


def test_extreme_parameters(spark):
    m = Ensemble.heterogeneous(spark.createDataFrame([(0, 50.0), (1, -50.0), (2, 800.0), (3, -800.0)], "id long, mu double"))
    d = column(stats.degree(m.nodes), "degree")
    assert np.isfinite(d).all() and d[3] == pytest.approx(0.5)
    f = m.pairs.free_energy().where("i <> j").toPandas().fe
    assert np.isfinite(f).all() and (f <= 0).all()


def test_identities(spark):
    m, mu = normal_model(spark, 60, -1.2)
    d = stats.degree(m.nodes).toPandas().degree
    assert stats.edge_count(m).first()[0] == pytest.approx(d.sum() / 2)
    assert stats.edge_density(m).first()[0] == pytest.approx(d.sum() / (60 * 59))
    f = stats.free_energy(m).first()[0]
    assert m.pairs.free_energy().agg(F.sum("fe") / 2).first()[0] == pytest.approx(f)
    h = 1e-5
    up = Ensemble.heterogeneous(m.table.withColumn("mu", F.col("mu") + F.when(F.col("id") == 7, h).otherwise(0.0)))
    assert (stats.free_energy(up).first()[0] - f) / h == pytest.approx(column(stats.free_energy_gradient(m.nodes), "gradient")[7], rel=1e-3)


def test_constant_vector_differs_from_scalar(spark):
    v = Ensemble.heterogeneous(spark.range(10).select("id", F.lit(-1.0).alias("mu")))
    assert stats.degree(v.nodes).first().degree == pytest.approx(stats.degree(Ensemble.homogeneous(spark, 10, -2.0).nodes).first().degree)


def test_results_do_not_depend_on_partitions(spark):
    m, _ = normal_model(spark, 40, -1.0)
    other = Ensemble.heterogeneous(m.table.repartition(7).orderBy(F.desc("id")))
    a, b = (stats.motifs(x.nodes, mc=20, seed=3) for x in (m, other))
    for k in stats.TRIANGLE + stats.QUADRANGLE:
        np.testing.assert_allclose(column(a, k), column(b, k))


@pytest.mark.parametrize(("motif", "draws", "error", "least"), [("triangle", 100, 0.05, 0.99), ("twedge", 50, 0.01, 0.99), ("thead", 100, 0.02, 0.99), ("quadrangle", 50, 0.05, 0.99), ("qwedge", 50, 0.05, 0.99), ("qhead", 50, 0.02, 0.99)])
def test_monte_carlo_motifs(spark, motif, draws, error, least):
    n = 500
    m, _ = normal_model(spark, n, -2.5)
    x = np.log(column(stats.motifs(m.nodes, (motif,), mc=False), motif))
    y = np.log(column(stats.motifs(m.nodes, (motif,), mc=draws, seed=1), motif))
    assert np.linalg.norm(x - y) / np.linalg.norm(x) < error
    assert np.corrcoef(x, y)[0, 1] > least


@pytest.mark.parametrize(("name", "repeat", "error", "least"), [("tclust", 20, 0.02, 0.95), ("tclosure", 5, 0.05, 0.99), ("similarity", 5, 0.05, 0.99), ("qclosure", 2, 0.05, 0.98)])
def test_monte_carlo_coefficients(spark, name, repeat, error, least):
    m, _ = normal_model(spark, 500 if name != "qclosure" else 200, -2.5)
    x = column(stats.coefficients(m.nodes, (name,), mc=False), name)
    y = column(stats.coefficients(m.nodes, (name,), mc=100 if name != "qclosure" else 30, seed=1, repeat=repeat), name)
    assert np.linalg.norm(x - y) / np.linalg.norm(x) < error
    assert np.corrcoef(x, y)[0, 1] > least


def test_views(spark):
    m, mu = normal_model(spark, 12, 0.0)
    full = column(stats.degree(m.nodes), "degree")
    part = stats.degree(m.nodes[[3, 3, 1]]).orderBy("pos").toPandas()
    np.testing.assert_allclose(part.degree, full[[3, 3, 1]])
    assert [r.id for r in m.nodes[1:-1:3].rows().orderBy("id").collect()] == [1, 4, 7, 10]
    assert m.nodes[F.col("mu") > 0].size() == int((mu > 0).sum())
    sub = m.nodes[[5, 2, 5]].materialize()
    assert sub.n == 2 and [r.id for r in sub.all_nodes.orderBy("id").collect()] == [0, 1]
    p = m.pairs.probs().toPandas()
    assert (p[p.i == p.j].p == 0).all() and len(p) == 144
    assert m.nodes[2].reset().size() == 12
    assert Ensemble.homogeneous(spark, 5, 0.0).nodes[[1, 2]].materialize().is_homogeneous


def test_errors(spark):
    m, _ = normal_model(spark, 5, 0.0)
    with pytest.raises(IndexError):
        m.nodes[1][2]
    with pytest.raises(ValueError, match="too many"):
        m.pairs[1, 2, 3]
    with pytest.raises(ValueError, match="positive"):
        Ensemble.homogeneous(spark, 0)
    with pytest.raises(ValueError, match="unique"):
        Ensemble.heterogeneous(spark.createDataFrame([(1, 0.0), (1, 1.0)], "id long, mu double"))
    with pytest.raises(Exception, match="no such node"):
        m.nodes[[99]].rows().collect()
    with pytest.raises(NotImplementedError):
        stats.moment(m.nodes, "degree", 2)
    with pytest.raises(ValueError, match="Monte Carlo"):
        stats.moment(m.nodes, "degree", mc=5)


def test_normalize_and_moment(spark):
    m, _ = normal_model(spark, 6, 0.0)
    np.testing.assert_allclose(column(stats.degree(m.nodes, normalize=True), "degree") * 6, column(stats.moment(m.nodes, "degree"), "degree"))
    assert stats.free_energy(m, normalize=True).first()[0] * 6 == pytest.approx(stats.free_energy(m).first()[0])
    assert math.isclose(stats.log_partition(m).first()[0], -stats.free_energy(m).first()[0])


def test_slices_and_shapes(spark):
    m, _ = normal_model(spark, 12, 0.0)
    for s in (slice(None, None, -1), slice(9, 2, -3), slice(-2, None, -4), slice(None, 3, -2), slice(2, 9, 3), slice(50, 1, -5), slice(3, 3, -1)):
        got = [r.id for r in m.nodes[s].rows().orderBy("pos").collect()]
        assert got == list(range(12))[s]
    assert m.nodes[3].shape() == () and m.nodes[[1, 1, 2]].shape() == (3,) and m.nodes[::-2].shape() == (6,) and m.nodes.shape() == (12,)
    assert m.nodes[3].ndim == 0 and sorted(r.id for r in m.nodes[[5, 1, 5]].unique().collect()) == [1, 5]
    p = m.pairs
    assert p.shape() == (12, 12) and p[2].shape() == (12,) and p[2, 3].shape() == () and p[[1, 2], [3, 4]].shape() == (2,) and p.outer([1, 2], [3, 4, 5]).shape() == (2, 3)
    assert p[2:5, [0, 1]].shape() == (3, 2) and p[2:5, [0, 1]].size() == 6 and p[[1, 1], [3, 3]].unique().count() == 1 and not p.is_active and p[1].is_active
    with pytest.raises(ValueError, match="step"):
        m.nodes[::0].rows()


def test_numbers_of_materialized_nodes(spark):
    m, mu = normal_model(spark, 30, 0.0)
    got = m.nodes[F.col("mu") > 0].materialize().all_nodes.orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(got))) and [r.mu for r in got] == [x for x in mu if x > 0]


def test_estimates_say_that_they_are(spark):
    m, _ = normal_model(spark, 1200, -3.0)
    with pytest.warns(UserWarning, match="estimates from 50 draws"):
        stats.motifs(m.nodes[:5], ("triangle",))
