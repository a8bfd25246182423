"""Spheres, layers and integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from netmoment.functions import expr as E
from netmoment.functions.variables import Constraint, Variable
from netmoment.operators import geometry
from netmoment.operators.geometry import GeometricModel, Layer, Sphere, dequantize, distances, quantize, quadrature
from netmoment.plans import catalogue

S, C = Layer("similarity"), Layer("complementarity")


def test_sphere():
    assert Sphere(2, 3.0).volume == pytest.approx(36 * math.pi)
    assert Sphere.with_volume(2, 100).volume == pytest.approx(100)
    assert Sphere(3).embedding_dim == 4
    with pytest.raises(ValueError, match="positive"):
        Sphere(0)


def test_points_and_distances(spark):
    s = Sphere(2, 3.0)
    points = s.sample_points(spark, 50, seed=4)
    x = np.array([r.x for r in points.orderBy("id").collect()])
    np.testing.assert_allclose(np.linalg.norm(x, axis=1), 3)
    got = {(r.i, r.j): r.g for r in distances(points, s).collect()}
    want = 3 * np.arccos(np.clip(x @ x.T / 9, -1, 1))
    assert len(got) == 50 * 49 // 2
    assert all(g == pytest.approx(want[k], abs=1e-6) for k, g in got.items())
    assert distances(points, s, condensed=False).count() == 2500
    with pytest.raises(Exception, match="different dimensions"):
        distances(points, s, other=Sphere(3, 3.0).sample_points(spark, 3)).collect()
    mean = s.sample_points(spark, 4000, seed=1).agg(*[F.avg(F.col("x")[k]) for k in range(3)]).first()
    assert max(map(abs, mean)) < 0.15


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_density_integrates_to_one(spark, dim):
    s = Sphere(dim, 1.7)
    assert quadrature(spark, 0, s.diameter, 64).agg(F.sum(F.col("w") * s.density(F.col("g")))).first()[0] == pytest.approx(1)


@pytest.mark.parametrize(("sphere", "value"), [(2, 0.12060938), (Sphere(4, 2.0), 0.04122784)])
def test_published_probability(spark, sphere, value):
    assert GeometricModel.of(100, sphere, S, C).expected_probability(spark).first().p == pytest.approx(value, abs=1e-7)


@pytest.mark.parametrize(("model", "value", "tolerance"), [(GeometricModel.of(100, 2, S), 0.24052459, 1e-5), (GeometricModel.of(100, Sphere(4, 2.0), S, C), 0.19198909, 1e-6), (GeometricModel.of(100, 1, S), 0.22321113, 1e-3)])
def test_published_clustering(spark, model, value, tolerance):
    assert model.expected_tclust(spark).first().tclust == pytest.approx(value, abs=tolerance)


def test_degree_of_samples(spark):
    m = GeometricModel.of(80, 2, S, C)
    edges = sum(m.sample(m.sphere.sample_points(spark, 80, seed=k), seed=k).count() for k in range(12)) / 12
    assert 2 * edges / 80 == pytest.approx(m.expected_degree(spark).first().degree, rel=0.1)
    nodes = spark.range(80).select("id", F.lit(0.0).alias("mu"))
    assert m.expected_degree(spark, nodes=nodes).first().degree == pytest.approx(m.expected_degree(spark).first().degree)


def test_edge_distances_integrate_to_one(spark):
    m = GeometricModel.of(100, 2, S)
    at = m.edge_distance_density(spark).join(m.quadrature(spark), "g")
    assert at.agg(F.sum(F.col("w") * F.col("density"))).first()[0] == pytest.approx(1)


def test_layers(spark):
    with pytest.raises(ValueError, match="negative"):
        Layer(beta=-1.0)
    with pytest.raises(ValueError, match="unknown"):
        Layer("other")
    hard = Layer(mu=1.0, beta=math.inf, log=False)
    got = [r[0] for r in spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "g double").select(hard.probability(F.col("g"), Sphere(2))).collect()]
    assert got == [1.0, 0.5, 0.0]
    m = GeometricModel.of(10, 2, S) + C
    assert len(m.layers) == 2 and m.without(0).layers == (C,)


def test_quantize(spark):
    nodes = spark.createDataFrame([(0, 0.11), (1, 0.13), (2, 0.5)], "id long, mu double")
    q = quantize(nodes, 1)
    assert sorted((r.code, r.w) for r in q.collect()) == [(0.1, 2), (0.5, 1)]
    assert dequantize(nodes, q.select("code", F.col("mu").alias("m")), 1).count() == 3


def test_constraints(spark):
    x = spark.createDataFrame([(0.3,), (0.9,)], "x double")
    for lo, hi, soft in [(None, None, False), (0.0, None, False), (None, 1.0, False), (0.0, 1.0, False), (0.0, None, True), (0.0, 1.0, True)]:
        y = x.select("x", E.constrain_back(E.constrain_free(F.col("x"), lo, hi, soft), lo, hi, soft).alias("y")).collect()
        assert all(r.x == pytest.approx(r.y) for r in y)
    with pytest.raises(Exception, match="out of bounds"):
        x.select(E.checked_bounds(F.col("x"), upper=0.5)).collect()


def test_antipode_distances_are_of_whole_tables(spark, sf_dir):
    got = catalogue.QUERIES["sphere_antipode_distances"](spark, sf_dir).toPandas().sort_values(["i", "j"])
    p = catalogue.points(spark, sf_dir).toPandas().sort_values("id")
    x = np.array(p["x"].tolist())
    assert len(got) == len(p) ** 2 and (got["i"].to_numpy() == np.repeat(p["id"].to_numpy(), len(p))).all() and (got["j"].to_numpy() == np.tile(p["id"].to_numpy(), len(p))).all()
    assert np.abs(got["g"].to_numpy() - np.arccos(np.clip(-x @ x.T, -1, 1)).ravel()).max() < 2e-6


def test_probabilities_of_all_ordered_pairs(spark):
    model = GeometricModel.of(6, Sphere(2), Layer("similarity", mu=0.3))
    points = model.sample_points(spark, seed=3)
    got = {(r.i, r.j): r.p for r in model.sample_pmatrix(points).collect()}
    half = {(r.i, r.j): r.p for r in model.pair_probs(points).collect()}
    assert len(got) == 36 and all(got[i, i] == 0 for i in range(6)) and all(got[i, j] == got[j, i] == p for (i, j), p in half.items())


def test_units_of_one_node_are_nodes(spark):
    model = GeometricModel.of(8, Sphere(2), Layer("similarity", mu=0.3))
    points = model.sample_points(spark, seed=4)
    want = model.sample_pmatrix(points).groupBy("i").sum("p").collect()
    got = {r.id: r.degree for r in model.unit_degree(points.withColumn("w", F.lit(1))).collect()}
    assert all(abs(got[r.i] - r["sum(p)"]) < 1e-12 for r in want)
    # a unit of three nodes is three nodes at one place
    three = points.withColumn("w", F.when(F.col("id") == 0, 3).otherwise(1))
    each = points.union(points.where("id = 0").withColumn("id", F.lit(100).cast("long"))).union(points.where("id = 0").withColumn("id", F.lit(101).cast("long")))
    want = {r.i: r["sum(p)"] for r in model.sample_pmatrix(each).groupBy("i").sum("p").collect()}
    assert all(abs(r.degree - want[r.id]) < 1e-9 for r in model.unit_degree(three).collect())


def test_parameters_of_layers(spark):
    model = GeometricModel.of(8, Sphere(2), Layer("similarity"), Layer("complementarity"))
    other = model.set_parameters({"mu": 0.2}, {"beta": 2.0})
    assert [(x.mu, x.beta) for x in other.layers] == [(0.2, 1.5), (0.0, 2.0)]
    points = model.sample_points(spark, seed=5).withColumns({"m": F.lit(0.1), "b": F.lit(1.0)})
    a = {(r.i, r.j): r.p for r in other.pair_probs(points).collect()}
    b = {(r.i, r.j): r.p for r in model.pair_probs(points, parameters=[("m", None), (None, "b")]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    for bad in (lambda: model.set_parameters({}), lambda: model.pair_probs(points, parameters=[("m", None)])):
        with pytest.raises(ValueError, match="layers"):
            bad()


def test_constraints(spark):
    c = Constraint(0.0, 2.0)
    rows = spark.createDataFrame([(0.5,), (None,), (2.0,)], "x double")
    assert [r[0] for r in rows.select(c.check(F.col("x"))).collect()] == [0.5, None, 2.0]
    assert [r[0] for r in rows.select(c.back(c.free(F.col("x")))).where("x is not null").collect()][0] == pytest.approx(0.5)
    with pytest.raises(Exception, match="out of bounds"):
        rows.select(Constraint(0.6).check(F.col("x"))).collect()
    with pytest.raises(ValueError, match="below"):
        Constraint(1.0, 1.0)
    Constraint(whole=True).check_type(IntegerType())
    for kind, x in ((StringType(), Constraint()), (DoubleType(), Constraint(whole=True))):
        with pytest.raises(TypeError, match="expected"):
            x.check_type(kind)


def test_arithmetic_of_variables(spark):
    x = Variable("x", Constraint(0.0))
    row = spark.createDataFrame([(3.0, [1, 2])], "x double, y array<int>").select(x + 1, 1 + x, x - 1, 1 - x, 2 * x, x * 2, x / 2, 6 / x, x**2, -x, +x, x.astype("int"), Variable("y")[1], x.checked(), x.free()).first()
    assert list(row)[:14] == [4, 4, 2, -2, 6, 6, 1.5, 2, 9, -3, 3, 3, 2, 3] and row[14] == pytest.approx(math.log(3))


def test_results_are_read_again(spark, tmp_path):
    from netmoment.sources.graphs import read_results, write_results

    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "n long, kind string, v double")
    for _ in range(2):
        write_results(rows, str(tmp_path / "out"), "kind")
    assert sorted((r.n, r.kind, r.v) for r in read_results(spark, str(tmp_path / "out")).collect()) == [(1, "a", 0.5), (2, "b", 1.5)]


def test_pairs_with_parameters_are_not_shuffled(spark, monkeypatch):
    """Parameters go with the points' blocks, in whichever order two ids come, and nulls stay null."""
    monkeypatch.setattr(geometry, "BLOCK", 4)
    points = geometry.Sphere(2).sample_points(spark, 15, seed=2).withColumns({"m": F.when(F.col("id") != 4, F.col("id") / 10.0), "b": 1 + F.col("id") / 7.0})
    model = geometry.GeometricModel.of(15, geometry.Sphere(2), geometry.Layer("similarity"))
    found = model.pair_probs(points, parameters=[("m", "b")])
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    own = {r.id: r for r in points.collect()}
    rows = found.collect()
    assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(15) for j in range(i + 1, 15)} and len(rows) == 105
    for r in rows:
        m, b = own[r.i].m, own[r.i].b + own[r.j].b
        if 4 in (r.i, r.j):
            assert r.p is None
            continue
        m += own[r.j].m
        assert r.p == pytest.approx(1 / (1 + np.exp(b * 2 * (np.log(max(r.g, 1e-9)) - m) + np.exp(-b) * (b + 1) * m)))


def test_unit_degrees_and_pairwise_values_by_blocks(spark, monkeypatch):
    """Sums of blocks, own mu included, against all pairs; a shuffled row is a point of two blocks or less."""
    from netmoment.operators import iteration

    monkeypatch.setattr(geometry, "BLOCK", 4)
    points = geometry.Sphere(2).sample_points(spark, 15, seed=2).withColumns({"w": F.col("id") % 3 + 1, "m": F.col("id") / 20.0})
    model = geometry.GeometricModel.of(15, geometry.Sphere(2), S, C)
    for mu in (None, "m"):
        found = model.unit_degree(points, mu)
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("MapInArrow") == 1
        own, want = {r.id: r for r in points.collect()}, dict.fromkeys(range(15), 0.0)
        for r in model.pair_probs(points, mu).collect():
            want[r.i] += own[r.j].w * r.p
            want[r.j] += own[r.i].w * r.p
        for r in points.select("id", ((F.col("w") - 1) * model.probability(F.lit(0.0), [None if mu is None else 2 * F.col(mu)] * 2)).alias("p")).collect():
            want[r.id] += r.p
        assert {r.id: pytest.approx(r.degree) for r in found.collect()} == want
    rows = {(r.i, r.j): r.value for r in iteration.pairwise_blocks(points, iteration.manhattan).collect()}
    assert rows == {(i, j): pytest.approx(sum(abs(a - b) for a, b in zip(own[i].x, own[j].x, strict=True))) for i in range(15) for j in range(i + 1, 15)}
