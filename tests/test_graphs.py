"""Sources, sampling, observed statistics and fits."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.operators import fit, grids, observed, sampling, stats
from netmoment.plans.model import Ensemble
from netmoment.sources import graphs


def random_graph(spark, n, p, seed=1):
    rng = np.random.default_rng(seed)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    return spark.range(n), spark.createDataFrame(pairs, "src long, dst long"), pairs


def brute_census(n, pairs):
    a = np.zeros((n, n), dtype=int)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    out = np.zeros((n, 6), dtype=int)
    for i, j, k in itertools.permutations(range(n), 3):
        out[i, 0] += a[i, j] * a[j, k] * a[i, k]
        out[i, 1] += a[i, j] * a[i, k]
        out[i, 2] += a[i, j] * a[j, k]
    for i, j, k, m in itertools.permutations(range(n), 4):
        out[i, 3] += a[i, j] * a[j, k] * a[k, m] * a[i, m] * (1 - a[i, k]) * (1 - a[j, m])
        out[i, 4] += a[i, j] * a[i, m] * a[j, k]
        out[i, 5] += a[i, j] * a[j, k] * a[k, m]
    out[:, 0] //= 2
    out[:, 3] //= 2
    return out


@pytest.mark.parametrize("p", [0.2, 0.5, 0.8])
def test_census_by_brute_force(spark, p):
    ids, edges, pairs = random_graph(spark, 11, p)
    got = observed.census(ids, edges).orderBy("id").toPandas()[list(observed.CENSUS)].to_numpy()
    np.testing.assert_array_equal(got, brute_census(11, pairs))


def test_path_lengths_by_brute_force(spark):
    ids, edges, pairs = random_graph(spark, 14, 0.15, seed=4)
    d = np.full((14, 14), 99)
    for i, j in pairs:
        d[i, j] = d[j, i] = 1
    for k in range(14):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    want = {(i, j): int(d[i, j]) for i in range(14) for j in range(14) if i != j and d[i, j] < 99}
    assert {(r.i, r.j): r.d for r in observed.path_lengths(ids, edges).collect()} == want and max(want.values()) > 3
    assert observed.path_lengths(ids, edges.limit(0)).count() == 0


def test_normalized_edge_count(spark):
    ids, edges, pairs = random_graph(spark, 11, 0.5)
    assert observed.edge_count(edges, ids).first()[0] == len(pairs) / 11 and observed.edge_count(edges).first()[0] == len(pairs)


@pytest.mark.parametrize("start", ["zeros", "random", "er", None])
def test_fits_from_any_start(spark, start):
    ids, edges, _ = random_graph(spark, 25, 0.3)
    want = fit.fit(ids, edges).orderBy("id").toPandas()["mu"].to_numpy()
    fitted, solution = fit.fit_degrees(ids, edges, start)
    np.testing.assert_allclose(fitted.orderBy("id").toPandas()["mu"].to_numpy(dtype=float), want, atol=1e-7)
    assert solution.converged and solution.error < 1e-6


def test_a_start_at_the_optimum_takes_one_step(spark):
    ids, edges, _ = random_graph(spark, 25, 0.3)
    found = fit.fit(ids, edges)
    again, solution = fit.fit_degrees(ids, edges, found)
    assert solution.iterations == 1 and again.count() == 25
    degree = observed.degree(ids, edges)
    expected = fit.expectations(found, ids).join(degree.withColumnRenamed("degree", "k"), "id").toPandas()
    np.testing.assert_allclose(expected.degree, expected.k, rtol=1e-6)


def test_fits_of_many_classes_are_distributed(spark):
    ids, edges, _ = random_graph(spark, 25, 0.3)
    want, _ = fit.fit_degrees(ids, edges)
    got, solution = fit.fit_degrees(ids, edges, newton_classes=2)
    assert solution.converged and solution.iterations > 3
    both = got.join(want.withColumnRenamed("mu", "other"), "id").toPandas()
    np.testing.assert_allclose(both.mu, both.other, atol=1e-4)


def test_fits_that_do_not_converge_say_so(spark):
    full = spark.createDataFrame(list(itertools.combinations(range(6), 2)), "src long, dst long")  # mu is infinite
    assert not fit.fit_degrees(spark.range(6), full)[1].converged
    with pytest.raises(RuntimeError, match="no convergence"):
        fit.fit(spark.range(6), full)


def test_targets_are_checked(spark):
    ids = spark.range(3)
    good = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id long, degree long")
    assert fit.checked_targets(ids, good).count() == 3
    for rows in ([(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, None), (2, 0)], [(0, 1), (1, 1), (1, 1)], [(0, 1), (1, 1), (7, 1)], [(0, 1), (1, -1), (2, 0)]):
        with pytest.raises(ValueError, match="targets"):
            fit.checked_targets(ids, spark.createDataFrame(rows, "id long, degree long"))


def test_complete_graph_in_every_form(spark):
    full = [[int(i != j) for j in range(10)] for i in range(10)]
    edges = graphs.from_matrix(spark, full, 10)
    assert [r.degree for r in observed.degree(spark.range(10), edges).collect()] == [9] * 10
    assert graphs.from_matrix(spark, np.array(full)).count() == 45
    assert observed.density(spark.range(10), edges).first()[0] == 1
    with pytest.raises(ValueError, match="square"):
        graphs.from_matrix(spark, [[0, 1]])
    with pytest.raises(ValueError, match="4 nodes"):
        graphs.from_matrix(spark, full, 4)


def test_graph_objects(spark):
    class Graph:
        def __init__(self, directed=False):
            self.directed = directed

        def is_directed(self):
            return self.directed

        def number_of_nodes(self):
            return 3

        def nodes(self):
            return ["a", "b", "c"]

        def edges(self):
            return [("a", "b"), ("c", "b")]

    assert sorted(map(tuple, graphs.from_graph(spark, Graph()).collect())) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError, match="undirected"):
        graphs.from_graph(spark, Graph(True))
    with pytest.raises(ValueError, match="expected 5"):
        graphs.from_graph(spark, Graph(), 5)


def test_empty_graph(spark):
    ids, edges = spark.range(4), spark.createDataFrame([], "src long, dst long")
    assert {tuple(r)[1:] for r in observed.census(ids, edges).collect()} == {(0,) * 6}
    assert observed.average_path_length(ids, edges).first()[0] is None
    assert fit.fit_degrees(ids, edges)[1].converged
    assert {r.mu for r in fit.fit(ids, edges).collect()} == {None}


def test_path_lengths(spark):
    ids, edges = spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "src long, dst long")
    got = {(r.i, r.j): r.d for r in observed.path_lengths(ids, edges).collect()}
    assert got[0, 3] == 3 and got[4, 5] == 1 and (0, 4) not in got and len(got) == 14


def test_samples_follow_the_model(spark):
    m = Ensemble.heterogeneous(spark.range(40).select("id", (F.col("id") / 20 - 2).alias("mu")))
    e = sampling.sample_edges(m, seed=1, replicates=60)
    mean = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg((F.count(F.lit(1)) / 60).alias("k"))
    both = stats.degree(m.nodes).join(mean, "id").toPandas()
    assert np.corrcoef(both.degree, both.k)[0, 1] > 0.98
    assert both.k.mean() == pytest.approx(both.degree.mean(), rel=0.05)
    again = sampling.sample_edges(m.replace(table=m.table.repartition(5)), seed=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sampling.sample_edges(m, seed=1).collect()))


def test_sparse_sample(spark):
    m = Ensemble.homogeneous(spark, 3000, -6.0)
    e = sampling.sample_sparse(m, seed=2)
    want = m.p * 3000 * 2999 / 2
    assert abs(e.count() - want) < 5 * want**0.5
    assert e.where("src >= dst or dst >= 3000").count() == 0 and e.distinct().count() == e.count()
    with pytest.raises(ValueError, match="one probability"):
        sampling.sample_sparse(Ensemble.heterogeneous(spark.range(3).select("id", F.lit(0.0).alias("mu"))))


def test_fits(spark):
    ids, edges, pairs = random_graph(spark, 200, 0.05, seed=3)
    mu = fit.homogeneous_mu(ids, edges).first().mu
    assert stats.edge_density(Ensemble.homogeneous(spark, 200, mu)).first()[0] == pytest.approx(2 * len(pairs) / (200 * 199))
    params, solution = fit.fit_degrees(ids, edges)
    assert solution.converged
    expected = stats.degree(Ensemble.heterogeneous(params.select("id", "mu")).nodes)
    both = expected.join(observed.degree(ids, edges).withColumnRenamed("degree", "k"), "id").toPandas()
    np.testing.assert_allclose(both.degree, both.k, rtol=1e-3, atol=5e-2)


def test_likelihood_identity(spark):
    ids, edges, _ = random_graph(spark, 30, 0.3)
    start = fit.initial(ids, edges, "zeros")
    a, b = fit.lagrangian(start, ids, edges).first()[0], fit.log_likelihood(start, ids, edges).first()[0]
    assert a == pytest.approx(-b) and b == pytest.approx(-30 * 29 / 2 * np.log(2))
    fitted = fit.fit(ids, edges)
    assert fit.log_likelihood(fitted, ids, edges).first()[0] > fit.log_likelihood(fit.fit(ids, edges, "homogeneous"), ids, edges).first()[0]
    with pytest.raises(NotImplementedError):
        fit.fit(ids, edges, method="least_squares")


def test_grids(spark):
    grid = grids.product(spark, n=[10, 20], beta=[0.5, 1.5])
    assert grid.count() == 4
    runs = grids.simulate(grid, 3, lambda r: {"n": r["n"], "beta": r["beta"], "x": r["n"] * r["beta"] + r["rep"]}, "n long, beta double, x double")
    assert {(r.n, r.beta): r.x for r in grids.group_mean(runs, ["n", "beta"], "x").collect()} == {(10, 0.5): 6, (10, 1.5): 16, (20, 0.5): 11, (20, 1.5): 31}


def test_edges_by_slots_write_no_pairs(spark, monkeypatch):
    """Users in several blocks, entries counted a few at a time, nulls left out; after the pairs of blocks there is no exchange."""
    monkeypatch.setattr(graphs, "AT_ONCE", 50)
    monkeypatch.setattr(graphs, "block_count", lambda n: 5)
    e = spark.range(900).selectExpr("if(id % 50 = 0, null, cast(xxhash64(id) % 40 as long)) as user_id", "timestamp_seconds(pmod(xxhash64(id, 1), 12) * 3600 + 60) as ts", "string(pmod(xxhash64(id, 2), 2)) as event_type")
    got = graphs.edges_by_slots(e, 3)
    slots = {(r.user_id, r.ts, r.event_type) for r in e.collect() if r.user_id is not None}
    of = {}
    for u, ts, kind in slots:
        of.setdefault(u, set()).add((ts, kind))
    want = {(u, v) for u in of for v in of if u < v and len(of[u] & of[v]) >= 3}
    rows = [tuple(r) for r in got.collect()]
    assert want and len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.index("MapInArrow") < plan.index("CartesianProduct") < plan.index("Exchange")


def test_jumps_of_small_chances_are_those_of_sql(spark, duck):
    p = 1.5e-7
    got = spark.range(100_000).select("id", sampling.jump((F.col("id") + 0.5) / 100_000, F.lit(p)).alias("step")).agg(F.sum("step"), F.sum(F.col("id") * F.col("step"))).first()
    want = duck.sql(f"SELECT sum(step), sum(id * step) FROM (SELECT id, CAST(floor(ln(1 - (id + 0.5::DOUBLE) / 100000) / ln(1 - {p!r}::DOUBLE)) AS BIGINT) + 1 AS step FROM range(100000) t(id))").fetchall()[0]
    assert tuple(got) == tuple(int(x) for x in want)
