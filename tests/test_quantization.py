"""Units of nodes with several parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.functions import expr as E
from netmoment.operators import geometry, quantization, stats
from netmoment.plans.model import Ensemble


@pytest.fixture(scope="module")
def nodes(spark):
    u = lambda tag: E.hash_uniform(tag, F.col("id"))
    return spark.range(400).select("id", (2 * u("a") - 2).alias("mu"), (u("b") + F.col("id") % 2).alias("beta"))


def test_rounded_parameters(nodes):
    q = quantization.rounded(nodes, {"mu": 1, "beta": 0})
    back, was = q.materialized().orderBy("id").toPandas(), nodes.orderBy("id").toPandas()
    key = list(zip(was.mu.round(1), was.beta.round(0), strict=True))
    assert q.units.agg(F.sum("w")).first()[0] == 400 == len(back) and q.units.count() == len(set(key))
    mean = was.groupby([was.mu.round(1), was.beta.round(0)])[["mu", "beta"]].transform("mean")
    np.testing.assert_allclose(back[["mu", "beta"]], mean, atol=1e-12)
    values = q.units.select("code", (F.col("mu") * 2).alias("twice"))
    assert np.allclose(q.dequantized(values).orderBy("id").toPandas().twice, 2 * back.mu)
    with pytest.raises(ValueError):
        quantization.rounded(nodes, {})


def test_codebooks_of_more_codes_are_nearer(nodes):
    errors = []
    for k in (1, 4, 32):
        q = quantization.codebook(nodes, ("mu", "beta"), k, seed=3)
        errors.append(q.error(nodes).first().error)
        assert 1 <= q.units.count() <= k and q.codes.count() == 400
    assert errors[0] == pytest.approx(nodes.agg(F.var_pop("mu") + F.var_pop("beta")).first()[0]) and errors[0] > 3 * errors[1] > 9 * errors[2]
    with pytest.raises(ValueError):
        quantization.codebook(nodes, ("mu",), 0)


def test_degrees_of_units_are_near_those_of_nodes(spark, nodes):
    q = quantization.codebook(nodes, ("mu",), 20, seed=1)
    assert q.ensemble().classes().count() <= 20
    want, got = (stats.degree(m.nodes).orderBy("id").toPandas().degree for m in (Ensemble.heterogeneous(nodes.select("id", "mu")), q.ensemble()))
    assert np.corrcoef(want, got)[0, 1] > 0.99 and got.sum() == pytest.approx(want.sum(), rel=0.01)
    # by layer: the units' own parameters for pairs of points
    q = quantization.codebook(nodes, ("mu", "beta"), 20, seed=1)
    points = spark.range(8).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.0)).alias("x")).join(q.materialized(), "id")
    p = geometry.GeometricModel.of(8, geometry.Sphere(2), geometry.Layer()).pair_probs(points, parameters=[("mu", "beta")])
    assert p.count() == 28 and p.where("p <= 0 or p >= 1").count() == 0
