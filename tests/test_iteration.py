"""Kernels of the caller, options and random columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.functions.random import RandomGenerator
from netmoment.operators import iteration, stats
from netmoment.operators.iteration import pair_probability as p
from netmoment.plans import options
from netmoment.plans.model import Ensemble


@pytest.fixture(scope="module")
def model(spark):
    mu = np.random.default_rng(1).normal(size=15) - 0.5
    return Ensemble.heterogeneous(spark.createDataFrame([(i, float(x)) for i, x in enumerate(mu)], "id long, mu double"))


def values(df, name="value"):
    return df.orderBy("id").toPandas()[name].to_numpy()


def test_kernels_give_the_motifs(model):
    triangle = iteration.iterate(model.nodes, 2, lambda i, j, k: p(i, j) * p(j, k) * p(i, k) / 2)
    np.testing.assert_allclose(values(triangle), values(stats.motifs(model.nodes, ("triangle",)), "triangle"))
    one = iteration.iterate(model.nodes, 0, lambda i: i["mu"] * 2)
    np.testing.assert_allclose(values(one), values(model.all_nodes, "mu") * 2)
    part = iteration.iterate(model.nodes[[3, 5]], 1, lambda i, j: p(i, j))
    np.testing.assert_allclose(values(part), values(stats.degree(model.nodes), "degree")[[3, 5]])


def test_sampled_kernels(model):
    kernel = lambda i, j, k: p(i, j) * p(j, k) * p(i, k) / 2
    got = iteration.iterate_sampled(model.nodes, 2, kernel, [p, lambda i, j, k: p(j, k)], 40, seed=2)
    want = values(stats.motifs(model.nodes, ("triangle",)), "triangle")
    assert np.corrcoef(values(got), want)[0, 1] > 0.95 and values(got).mean() == pytest.approx(want.mean(), rel=0.05)


def test_options(model):
    assert options.get("mc_above") == 1000
    with options.using(mc_above=5, mc_draws=3):
        assert options.to_dict()["mc_draws"] == 3
        rough = values(stats.motifs(model.nodes, ("triangle",)), "triangle")
    assert options.get() == options.Options()
    assert not np.allclose(rough, values(stats.motifs(model.nodes, ("triangle",)), "triangle"))
    np.testing.assert_allclose(values(stats.motifs(model.nodes, ("triangle",), mc=False), "triangle"), values(stats.motifs(model.nodes, ("triangle",)), "triangle"))
    with options.using(exact_nodes=3), pytest.raises(ValueError, match="more than"):
        stats.motifs(model.nodes, ("triangle",))
    with pytest.raises(ValueError, match="positive"):
        options.set_(mc_draws=0)
    options.set_(mc_draws=7)
    assert options.reset().mc_draws == 50


def test_random_columns(spark):
    g = RandomGenerator.of(3)
    assert RandomGenerator.of(g) is g and g.child("a") != g.child("b") and len(set(g.split(4))) == 4
    assert RandomGenerator.of().seed >= 0
    x = spark.range(4000).select(g.normal(F.col("id"), mean=2.0).alias("n"), g.exponential(F.col("id"), rate=4.0).alias("e"), g.choice(5, F.col("id")).alias("c")).toPandas()
    assert abs(x.n.mean() - 2) < 0.06 and abs(x.n.std() - 1) < 0.05 and abs(x.e.mean() - 0.25) < 0.02
    assert x.c.value_counts().min() > 650 and set(x.c) == set(range(5))


def test_helpers(spark):
    n = spark.createDataFrame([(0,), (5,), (6,)], "n long").select(iteration.batch_slices(F.col("n"), 3).alias("b")).collect()
    assert [[tuple(x) for x in r.b] for r in n] == [[], [(0, 3), (3, 5)], [(0, 3), (3, 6)]]
    pts = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [5.0])], "id long, x array<double>")
    d = iteration.pairwise(pts, lambda a, b: F.abs(a[0] - b[0]))
    assert {(r.i, r.j): r.value for r in d.collect()} == {(0, 1): 2, (0, 2): 5, (1, 2): 3}
    assert iteration.squareform(d).count() == 6 and iteration.pairwise(pts, lambda a, b: a[0], condensed=False).count() == 9


@pytest.mark.parametrize("unique", [True, False, "earlier"])
def test_ranged_paths_are_the_sampled_ones(model, unique):
    """The same draws as with all nodes met at each depth, whatever must not be drawn again; weights that allow a node itself make the difference."""
    weight = lambda a, b: 1 / (1 + F.exp(-(a["mu"] + b["mu"])))
    kernel = lambda i, j, k, l: (i["id"] + 1) * (j["mu"] + 2) * (k["mu"] + 3) / (l["mu"] + 4)  # noqa: E731, E741
    view = model.nodes[:4]
    want = iteration.iterate_sampled(view, 3, kernel, [weight, lambda i, j, k: weight(j, k), lambda i, j, k, m: weight(k, m)], 3, seed=2, unique=unique)
    got = iteration.iterate_ranged(view, 3, kernel, weight, 3, seed=2, unique=unique)
    np.testing.assert_allclose(values(got, "value"), values(want, "value"), rtol=1e-9)
    with pytest.raises(ValueError, match="unique"):
        iteration.iterate_ranged(view, 2, kernel, weight, 3, unique="later")


@pytest.mark.parametrize("unique", [True, False, "earlier"])
def test_paths_of_many_nodes_store_no_ranges(spark, monkeypatch, unique):
    """The same draws without a row for each pair, where few points stand for all nodes."""
    mu = np.random.default_rng(4).uniform(-2, 0, 300)
    view = Ensemble.heterogeneous(spark.createDataFrame([(i, float(x)) for i, x in enumerate(mu)], "id long, mu double")).nodes[:3]
    kernel = lambda i, j, k: (i["id"] + 1) * (j["mu"] + 2) * (k["id"] + 3) * (j["id"] + 1)
    want = values(iteration.iterate_ranged(view, 2, kernel, p, 4, seed=2, unique=unique), "value")
    monkeypatch.setattr(iteration.lines, "LEAST", 100)
    monkeypatch.setattr(iteration, "cut", None)
    monkeypatch.setattr(iteration, "PATHS", 5)
    np.testing.assert_allclose(values(iteration.iterate_ranged(view, 2, kernel, p, 4, seed=2, unique=unique), "value"), want, rtol=1e-9)


def test_products_take_a_term_for_each_pair(spark):
    """The same sums as all tuples give, for three factors and repeated nodes too; a plan without tuples is over at once for more nodes than tuples could be listed of."""
    model = Ensemble.heterogeneous(spark.range(7).select("id", (F.col("id") / 3 - 1).alias("mu")))
    f, g, h = iteration.pair_probability, lambda i, j: j["mu"] * j["mu"] + i["mu"], lambda i, j: j["mu"] - 2 * i["mu"]
    for factors in ([f], [f, f], [f, g, h], [f, g, h, f]):
        for unique in (True, False):
            want = values(iteration.iterate(model.nodes, len(factors), lambda i, *v, fs=factors: math.prod(x(i, y) for x, y in zip(fs, v, strict=True)), unique=unique), "value")
            assert values(iteration.iterate_product(model.nodes, factors, unique), "value") == pytest.approx(want)
    assert len(values(iteration.iterate_product(model.nodes[[2, 5]], [f, g]), "value")) == 2
    many = Ensemble.heterogeneous(spark.range(4000).select("id", F.lit(0.0).alias("mu")))
    assert iteration.iterate_product(many.nodes, [f, f]).agg(F.sum("value")).first()[0] == pytest.approx(4000 * 3999 * 3998 / 4)
