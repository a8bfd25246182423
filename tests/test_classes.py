"""Motifs by classes of mu, and samples by jumps, against the kernels and plain loops."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmoment.functions import expr as E
from netmoment.operators import classes, sampling, stats
from netmoment.plans import options
from netmoment.plans.model import Ensemble

ALL = stats.TRIANGLE + stats.QUADRANGLE


@pytest.fixture(scope="module")
def model(spark):
    """23 nodes of few distinct parameters, some of one node, some of many."""
    rows = [(i * 3, [-1.5, -1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1.5, -2.0][(i * i + i // 2) % 9 if i < 18 else 2]) for i in range(23)]
    return Ensemble.heterogeneous(spark.createDataFrame(rows, "id long, mu double"))


def values(df, names=ALL):
    return df.select("id", *names).orderBy("id").toPandas().set_index("id")


def test_exact_by_classes(model):
    want = values(stats.motifs(model.nodes, ALL, mc=False, by="nodes"))
    np.testing.assert_allclose(values(stats.motifs(model.nodes, ALL, mc=False, by="classes")), want, rtol=1e-9)
    some = stats.motifs(model.nodes[[3, 60, 3]], ("quadrangle", "qhead"), mc=False, by="classes").orderBy("pos").toPandas()
    np.testing.assert_allclose(some[["quadrangle", "qhead"]], want.loc[[3, 60, 3], ["quadrangle", "qhead"]], rtol=1e-9)
    with pytest.raises(ValueError, match="by nodes or classes"):
        stats.motifs(model.nodes, mc=False, by="edges")


@pytest.mark.parametrize("side", [1, 2, 4, 100])
def test_blocks_do_not_matter(model, monkeypatch, side):
    want = values(stats.motifs(model.nodes, ALL, mc=False, by="nodes"), ["triangle", "quadrangle"])
    monkeypatch.setattr(classes, "_side", lambda k, most: side)
    np.testing.assert_allclose(values(stats.motifs(model.nodes, ("triangle", "quadrangle"), mc=False, by="classes"), ["triangle", "quadrangle"]), want, rtol=1e-9)


def test_more_nodes_than_kernels_take(model):
    want = values(stats.motifs(model.nodes, ("triangle",), mc=False, by="nodes"), ["triangle"])
    k = model.classes().count()
    with options.using(exact_nodes=k + 1):  # fewer than nodes
        np.testing.assert_allclose(values(stats.motifs(model.nodes, ("triangle",), mc=False), ["triangle"]), want, rtol=1e-9)
    with options.using(exact_nodes=k - 1), pytest.raises(ValueError, match=f"{k} classes of mu are more than"):
        stats.motifs(model.nodes, ("triangle",), mc=False)


def test_estimates_by_classes(model):
    want = values(stats.motifs(model.nodes, ALL, mc=False))
    got = stats.motifs(model.nodes, ALL, mc=12, repeat=60, seed=1, by="classes")
    assert got.schema["triangle"].metadata == {"estimate": True, "draws": 12}
    got = values(got)
    for k in ALL:
        assert got[k].mean() == pytest.approx(want[k].mean(), rel=0.02), k
        assert np.corrcoef(got[k], want[k])[0, 1] > 0.98, k
    same = stats.motifs(model.replace(table=model.table.repartition(5)).nodes, ALL, mc=12, repeat=60, seed=1, by="classes")
    np.testing.assert_allclose(values(same), got, rtol=1e-9)
    with options.using(mc_nodes=5):  # more nodes than the kernels take
        assert values(stats.motifs(model.nodes, ("triangle",), mc=3), ["triangle"]).triangle.min() > 0
    each = stats.motifs(model.nodes, ("triangle", "qwedge"), mc=3, repeat=2, average=False, same_seed=False, by="classes")
    assert each.count() == 46 and each.columns == ["pos", "id", "rep", "triangle", "qwedge"]


def test_estimates_of_a_large_model(spark):
    """The published thresholds of error and correlation, for 500 nodes of normal mu in steps of an eighth: logarithms of counts, and coefficients.  Rounded, heads need twice the draws, by nodes too."""
    mu = np.round(np.random.default_rng(17).normal(-2.5, 1, 500) * 8) / 8
    m = Ensemble.heterogeneous(spark.createDataFrame(list(enumerate(mu.tolist())), "id long, mu double"))
    exact = values(stats.motifs(m.nodes, ALL, mc=False, by="classes"))
    of_draws = {50: ["twedge", "quadrangle", "qwedge", "qhead"], 100: ["triangle"], 200: ["thead"]}
    got = {k: x[k] for n, names in of_draws.items() for x in (values(stats.motifs(m.nodes, tuple(names), mc=n, seed=3, by="classes"), names),) for k in names}
    for k, most in {"triangle": 0.05, "twedge": 0.01, "thead": 0.02, "quadrangle": 0.05, "qwedge": 0.05, "qhead": 0.02}.items():
        a, b = np.log(exact[k]), np.log(got[k])
        assert np.linalg.norm(a - b) < most * np.linalg.norm(a) and np.corrcoef(a, b)[0, 1] > 0.99, k
    names = ["tclosure", "similarity"]
    a, b = (values(stats.tstats(m.nodes, **o), names) for o in ({"mc": False}, {"mc": 100, "repeat": 5, "seed": 4, "by": "classes"}))
    for k in names:
        assert np.linalg.norm(a[k] - b[k]) < 0.05 * np.linalg.norm(a[k]) and np.corrcoef(a[k], b[k])[0, 1] > 0.99, k


# Samples


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def test_hits_are_the_jumps(spark):
    rows = [(1, 50, 0.1), (2, 3000, 0.02), (3, 40, 1.0), (4, 10, 0.0), (5, 0, 0.5), (6, 10**15, 1e-14)]
    df = spark.createDataFrame(rows, "k long, length long, p double")
    want = []
    for k, length, p in rows:
        at, number = -1, 0
        while p > 0:
            number += 1
            at += 1 if p >= 1 else int(math.log(1 - uniform(9, k, number)) / math.log1p(-p)) + 1
            if at >= length:
                break
            want.append((k, at))
    for spare in (-1.5, 0.0, 8.0):  # rows that must go on, and rows that need not
        assert sorted((r.k, r.at) for r in sampling.hits(df, 9, ["k"], spare).collect()) == want
    assert len(want) > 80


def test_many_jumps_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(sampling, "IN_ONE_GO", 7)
    df = spark.createDataFrame([(1, 200, 1.0), (2, 500, 0.3)], "k long, length long, p double")
    got = sampling.hits(df, 1, ["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.count_distinct("at").alias("d")).orderBy("k").collect()
    assert (got[0].n, got[0].last, got[0].d) == (200, 199, 200) and got[1].n == got[1].d and 100 < got[1].n < 200


def test_blocks_cover_all_cells(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PER_ROW", 3)
    rows = [(1, 1000, 0.5), (2, 7, 1e-9), (3, 100, 1.0), (4, 0, 0.5), (5, 9, 0.0)]
    got = sampling.in_blocks(spark.createDataFrame(rows, "k long, cells long, p double"), 4).orderBy("k", "block").collect()
    for k, cells, p in rows:
        own = [r for r in got if r.k == k]
        assert [r.block for r in own] == list(range(len(own))) and (sum(r.length for r in own) >= cells and (len(own) - 1) * own[0].length < cells if cells and p else not own)


def test_graphs_follow_the_model(spark):
    """Counts of each edge over replicates, against its chance: a chi-squared of 780 pairs."""
    m = Ensemble.heterogeneous(spark.range(40).select((F.col("id") * 7).alias("id"), (F.col("id") / 10 - 3).alias("mu")))
    reps = 200
    e = sampling.sample_graph(m, seed=1, replicates=reps, width=0.7, per_block=3, spare=0.0)
    counts = Counter((r.src, r.dst) for r in e.collect())
    assert all(a < b for a, b in counts) and e.distinct().count() == sum(counts.values())
    p = {(7 * i, 7 * j): 1 / (1 + math.exp(-(i / 10 - 3 + j / 10 - 3))) for i in range(40) for j in range(i + 1, 40)}
    assert set(counts) <= set(p)
    chi = sum((counts[k] - reps * v) ** 2 / (reps * v * (1 - v)) for k, v in p.items())
    assert abs(chi - len(p)) < 5 * math.sqrt(2 * len(p))
    again = sampling.sample_graph(m.replace(table=m.table.repartition(5)), seed=1, replicates=3, width=0.7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sampling.sample_graph(m, seed=1, replicates=3, width=0.7).collect()))


def test_dense_and_odd_graphs(spark):
    full = Ensemble.heterogeneous(spark.range(12).select("id", F.lit(50.0).alias("mu")))
    assert sampling.sample_graph(full).count() == 66
    far = Ensemble.heterogeneous(spark.createDataFrame([(1, -9000.0), (2, 5000.0), (3, 4000.0), (4, -5.0)], "id long, mu double"))
    assert sorted(map(tuple, sampling.sample_graph(far).collect())) == [(2, 3), (2, 4), (3, 4)]
    one = Ensemble.heterogeneous(spark.range(1).select("id", F.lit(1.0).alias("mu")))
    assert sampling.sample_graph(one).count() == 0
    flat = Ensemble.homogeneous(spark, 2000, -6.0)
    want = flat.p * 2000 * 1999 / 2
    assert abs(sampling.sample_graph(flat, seed=4).count() - want) < 5 * want**0.5
    with pytest.raises(ValueError, match="width"):
        sampling.sample_graph(full, width=0.0)


def test_work_is_in_proportion_to_edges(spark):
    """Candidates for each edge of 3000 nodes: far fewer than the pairs."""
    m = Ensemble.heterogeneous(spark.range(3000).select("id", (E.hash_uniform(1, F.col("id")) * 2 - 4).alias("mu")))
    nodes, k = sampling.mu_classes(m, 0.25)
    a, b = (k.select(*[F.col(c).alias(f"{c}_{x}") for c in k.columns]) for x in "ab")
    pairs = a.join(b, F.col("k_a") <= F.col("k_b")).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), (F.col("n_a") * F.col("n_b")).alias("cells"), E.probability(-(F.col("top_a") + F.col("top_b"))).alias("p"))
    found, edges = sampling.candidates(pairs, 0, ["a", "b"]).count(), sampling.sample_graph(m).count()
    assert edges < found < 3 * edges < 3000 * 2999 / 2 / 10


def test_draws_are_no_rows(model, monkeypatch):
    """Up to FEW_CLASSES each task draws by itself; beyond, the same draws are rows, which the planner takes for few and must not broadcast."""
    ask = lambda **o: stats.motifs(model.nodes, ALL, mc=4, repeat=3, seed=7, by="classes", average=False, **o)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = {same: ask(same_seed=same) for same in (True, False)}
    assert not any("explode" in plan(x) for x in got.values())
    monkeypatch.setattr(classes, "FEW_CLASSES", 0)
    one = stats.motifs(model.nodes, ("thead",), mc=4, seed=7, by="classes").select("id", "thead")
    for block in plan(one).split("BroadcastExchange")[1:]:
        assert "explode" not in block.split("SortMergeJoin")[0]
    for same, x in got.items():
        a, b = (y.orderBy("id", "rep").toPandas() for y in (x, ask(same_seed=same)))
        assert a.columns.tolist() == b.columns.tolist() and len(a) == len(b) > 0
        np.testing.assert_allclose(a[list(ALL)], b[list(ALL)], rtol=1e-9)
        assert a[["id", "rep"]].equals(b[["id", "rep"]])
