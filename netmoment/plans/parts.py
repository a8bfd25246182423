"""Queries of views, moments, starts of fits, settings, random numbers, simulations and result files, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import RandomGenerator
from ..operators import fit, geometry, grids, iteration, observed, quantization, stats
from ..sources.checkpoints import shared_folder
from ..sources.graphs import read, read_results, write_results
from . import options
from .catalogue import _COEF_SQL, _T_FROM, CHUNG_LU, GRAPH, N_SUPPLIER, ORACLES, UNIFORM, D, P, _r, customer, graph, query, rounded, supplier

# Views

@query(f"WITH {N_SUPPLIER} SELECT id, {_r('mu', 'mu')} FROM n WHERE id < 7")
def nodes_reset(spark: SparkSession, d: str) -> DataFrame:
    """A selection taken back, and another one made."""
    return rounded(supplier(spark, d).nodes[[1, 3]].reset()[:7].rows().select("id", "mu"))


@query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r('p', 'p')} FROM p WHERE j IN (2, 3)")
def pairs_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).pairs[..., [2, 3]].probs().select("i", "j", "p"))


@query(f"WITH {N_SUPPLIER} SELECT id, {_r('mu', 'mu')} FROM n WHERE mu <= -1")
def node_parameter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[F.col("mu") <= -1].parameter().select("id", "mu"))


@query(f"WITH {N_SUPPLIER}, s AS (SELECT row_number() OVER (ORDER BY u, id) - 1 AS pos, id FROM (SELECT *, {UNIFORM.format("'8:' || id || ':' || id")} AS u FROM n)) SELECT pos, id FROM s WHERE pos < (SELECT count(*) // 2 FROM n)")
def sample_half_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = supplier(spark, d)
    return m.nodes.sample(m.n // 2, seed=8).select("pos", "id")


# Moments, sums of order 0

@query(f"WITH {_T_FROM} SELECT t.i AS id, {_r(_COEF_SQL['tclust'], 'tclust')}, {_r('d.d', 'degree')} FROM t JOIN tw ON t.i = tw.i JOIN d ON d.i = t.i")
def moments_first(spark: SparkSession, d: str) -> DataFrame:
    """Expectations by name."""
    v = supplier(spark, d).nodes
    return rounded(stats.moment(v, "tclust", mc=False).select("id", "tclust").join(stats.moment(v, "degree").select("id", "degree"), "id"))


@query(f"WITH {N_SUPPLIER} SELECT id, {_r('mu * mu', 'value')} FROM n")
def iterate_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A kernel of the focal node alone."""
    return rounded(iteration.iterate(supplier(spark, d).nodes, 0, lambda i: i["mu"] * i["mu"]))


@query(ORACLES["mc_triangle"])
def mc_by_options(spark: SparkSession, d: str) -> DataFrame:
    """Settings that make estimates the default for a while, and how many draws they take."""
    view = supplier(spark, d).nodes
    with options.using(mc_above=view.model.n, mc_draws=10):
        return rounded(stats.motifs(view, ("triangle",), mc=options.get("mc_draws"), seed=5).select("id", "triangle"))


# Starts of fits, expectations under given parameters

@query(f"WITH {GRAPH} SELECT id, 0.0::DOUBLE AS mu FROM u")
def fit_init_zeros(spark: SparkSession, d: str) -> DataFrame:
    return fit.initial(*graph(spark, d), "zeros").select("id", "mu")


@query(f"WITH {GRAPH} SELECT id, CAST(k AS DOUBLE) AS degree FROM k")
def fit_from_table(spark: SparkSession, d: str) -> DataFrame:
    """Expected degrees under a fit that starts from a table, one value for each node."""
    ids, edges = graph(spark, d)
    start = ids.select("id", (F.col("id") % 7 / 10.0 - 2.0).alias("mu"))
    fitted = observed.cut(fit.fit(ids, edges, start=start).select("id", "mu"))
    return fit.expectations(fitted, ids).select("id", F.round("degree", 3).alias("degree"))


@query(f"WITH {CHUNG_LU}, {P}, {D} SELECT u.id, {_r('coalesce(d, 0)', 'degree')} FROM u LEFT JOIN d ON d.i = u.id")
def fit_expectations(spark: SparkSession, d: str) -> DataFrame:
    ids, edges = graph(spark, d)
    return rounded(fit.expectations(fit.initial(ids, edges, "cm"), ids).select("id", "degree"))


@query(f"WITH {GRAPH} SELECT id, k AS degree FROM k")
def fit_targets(spark: SparkSession, d: str) -> DataFrame:
    """Degrees that are possible ones of exactly these nodes."""
    ids, edges = graph(spark, d)
    return fit.checked_targets(ids, observed.degree(ids, edges)).select("id", F.col("degree").cast("long").alias("degree"))


# Spheres of a volume, random numbers

@query(f"WITH n AS (SELECT count(*) AS n FROM customer) SELECT {_r(f'sqrt(n / {4 * math.pi!r}::DOUBLE)', 'radius')}, {_r(f'{math.pi!r}::DOUBLE * sqrt(n / {4 * math.pi!r}::DOUBLE)', 'diameter')}, {_r('n::DOUBLE', 'volume')}, 3 AS embedding_dim FROM n")
def sphere_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """The sphere with a unit of surface for each customer."""
    s = geometry.Sphere.with_volume(2, float(read(spark, d, "customer").count()))
    return rounded(spark.createDataFrame([(s.r, s.diameter, s.volume, s.embedding_dim)], "radius double, diameter double, volume double, embedding_dim int"))


_G5 = RandomGenerator(5)


def _of_child(tag: object, parts: str) -> str:
    return UNIFORM.format(f"'{_G5.child(tag).seed}:' || {parts}")


@query(f"SELECT s_suppkey AS id, {_r(_of_child('noise', 's_suppkey'), 'noise')}, {_r(_of_child(0, 's_suppkey'), 'first')}, {_r(_of_child(1, 's_suppkey'), 'second')} FROM supplier")
def random_children(spark: SparkSession, d: str) -> DataFrame:
    """Independent generators for a purpose, and a generator split in two."""
    first, second = _G5.split(2)
    i = F.col("s_suppkey")
    return rounded(read(spark, d, "supplier").select(i.alias("id"), _G5.child("noise").uniform(i).alias("noise"), first.uniform(i).alias("first"), second.uniform(i).alias("second")))


_U = UNIFORM.format("'5:' || s_suppkey")


@query(f"""WITH u AS (SELECT s_suppkey AS id, {_U} AS u FROM supplier) SELECT id, CAST(floor(u * 9) AS BIGINT) - 4 AS whole, {_r('1 + 2 * ln(u / (1 - u))', 'logistic')}, {_r('-3 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))', 'laplace')},
  {_r('2 - ln(-ln(u))', 'gumbel')}, {_r(f'tan({math.pi!r}::DOUBLE * (u - 0.5))', 'cauchy')}, CAST(floor(ln(1 - u) / ln(1 - 0.25)) AS BIGINT) + 1 AS geometric, {_r('pow(1 - u, -1 / 2.5)', 'pareto')}, {_r('2 * pow(-ln(1 - u), 1 / 1.5)', 'weibull')} FROM u""")
def random_distributions(spark: SparkSession, d: str) -> DataFrame:
    g, i = _G5, F.col("s_suppkey")
    return rounded(read(spark, d, "supplier").select(
        i.alias("id"), g.randint(-4, 5, i).alias("whole"), g.logistic(i, mean=1.0, scale=2.0).alias("logistic"), g.laplace(i, scale=3.0).alias("laplace"), g.gumbel(i, mean=2.0).alias("gumbel"),
        g.cauchy(i).alias("cauchy"), g.geometric(0.25, i).alias("geometric"), g.pareto(i, shape=2.5).alias("pareto"), g.weibull(i, shape=1.5, scale=2.0).alias("weibull"),
    ))


# Simulations and their files

@query("SELECT CAST(r_regionkey AS BIGINT) AS region, rep, round(r_regionkey * 10 + rep / 2.0, 6) + 0.0 AS x FROM region, range(3) t(rep) WHERE r_regionkey * 10 + rep / 2.0 > 5")
def grid_simulated(spark: SparkSession, d: str) -> DataFrame:
    """A function of each row of a grid and replicate, and the results that pass a condition."""
    grid = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region"))
    runs = grids.simulate(grid, 3, lambda r: {"region": r["region"], "rep": r["rep"], "x": r["region"] * 10 + r["rep"] / 2}, "region long, rep long, x double")
    return rounded(runs.where("x > 5"))


@query(f"WITH n AS (SELECT c_custkey AS id, c_acctbal / 5000 - 3 AS mu, c_mktsegment AS segment FROM customer) SELECT id, {_r('mu', 'mu')}, segment FROM n WHERE segment <> 'BUILDING'")
def results_in_files(spark: SparkSession, d: str) -> DataFrame:
    """Results written by key to the shared folder, and some keys' read again."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = customer(spark, d).all_nodes.join(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id")
    write_results(rows, path, "segment")
    return rounded(read_results(spark, path).where("segment <> 'BUILDING'").select("id", "mu", "segment"))


# Nodes of several parameters, merged into units

_TWO_PARAMETERS = "n AS (SELECT c_custkey AS id, c_acctbal / 5000 - 3 AS mu, c_nationkey / 10.0::DOUBLE AS beta FROM customer)"


def two_parameters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_acctbal / 5000 - 3").alias("mu"), F.expr("c_nationkey / 10.0D").alias("beta"))


@query(f"WITH {_TWO_PARAMETERS} SELECT id, {_r('avg(mu) OVER u', 'mu')}, {_r('avg(beta) OVER u', 'beta')}, count(*) OVER u AS w FROM n WINDOW u AS (PARTITION BY round(mu, 1), round(beta, 0))")
def quantize_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Each node with the parameters and the weight of its unit."""
    q = quantization.rounded(two_parameters(spark, d), {"mu": 1, "beta": 0})
    return rounded(q.dequantized(q.units).select("id", "mu", "beta", "w"))


@query(f"""WITH {_TWO_PARAMETERS}, u AS (SELECT id, avg(mu) OVER (PARTITION BY round(mu, 1), round(beta, 0)) AS mu FROM n), k AS (SELECT mu, count(*) AS w FROM u GROUP BY mu),
  e AS (SELECT a.mu, sum((b.w - (a.mu = b.mu)::INT) / (1 + exp(-(a.mu + b.mu)))) AS degree FROM k a CROSS JOIN k b GROUP BY a.mu) SELECT u.id, round(e.degree, 4) + 0.0 AS degree FROM u JOIN e ON e.mu = u.mu""")
def quantize_degree(spark: SparkSession, d: str) -> DataFrame:
    """Expected degrees of the model of the units."""
    m = quantization.rounded(two_parameters(spark, d), {"mu": 1, "beta": 0}).ensemble()
    return stats.degree(m.nodes).select("id", (F.round("degree", 4) + F.lit(0.0)).alias("degree"))


@query(f"WITH {_TWO_PARAMETERS} SELECT count(*) AS nodes, count(DISTINCT id) AS ids, TRUE AS few, TRUE AS near FROM n")
def quantize_codebook(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the units of a codebook of 24 stand for, and whether they explain nine tenths of the parameters' variance."""
    n = two_parameters(spark, d)
    q = quantization.codebook(n, ("mu", "beta"), 24, seed=4)
    whole = n.agg((F.var_pop("mu") + F.var_pop("beta")).alias("variance"))
    units = q.units.agg(F.sum("w").alias("nodes"), (F.count(F.lit(1)) <= 24).alias("few"))
    ids = q.codes.agg(F.count_distinct("id").alias("ids"))
    return units.crossJoin(ids).crossJoin(q.error(n)).crossJoin(whole).select("nodes", "ids", "few", (F.col("error") < 0.1 * F.col("variance")).alias("near"))
