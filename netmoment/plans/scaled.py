"""Queries of the operators whose work does not grow with the square of the nodes, on customers, and their SQL.

SQL sums over classes literally, with how many nodes of a class are left once others are taken, and replays draws and jumps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, fit, geometry, iteration, observed, sampling, stats
from ..sources.graphs import nodes, read
from .catalogue import _COEF_SQL, _PP, _QUAD, _R2, _TWO, GRAPH, N_CUSTOMER, N_SUPPLIER, ORACLES, UNIFORM, D, P, _density_sql, _layer_sql, _r, _union_sql, customer, graph, query, rounded, supplier
from .model import Ensemble

# Samples by jumps

WIDTH, PER_BLOCK = 0.25, sampling.PER_BLOCK


def _sample_sql(seed: int, reps: int | None = None) -> str:
    """Tables up to e(rep, src, dst): blocks of pairs of classes, jumps in them, and the candidates that are edges."""
    key = f"'{seed}:' || {'rep || ' + repr(':') + ' || ' if reps else ''}a || ':' || b || ':' || block || ':' || k"
    pair = f"'{seed}:' || {'rep || ' + repr(':') + ' || ' if reps else ''}least(i.id, j.id) || ':' || greatest(i.id, j.id)"
    return f"""{N_CUSTOMER}, c AS (SELECT id, mu, CAST(floor(mu / {WIDTH}) AS BIGINT) AS k FROM n), g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS r FROM c),
  s AS (SELECT k, count(*) AS n, max(mu) AS top FROM c GROUP BY k),
  q AS (SELECT a.k AS a, b.k AS b, b.n AS n_b, a.n * b.n AS cells, 1 / (1 + exp(-(a.top + b.top))) AS p FROM s a JOIN s b ON a.k <= b.k),
  m AS (SELECT *, CAST(least(greatest(ceil(cells * p / {PER_BLOCK}), 1), cells) AS BIGINT) AS blocks FROM q),
  l AS (SELECT *, CAST(ceil(cells / blocks) AS BIGINT) AS length, unnest(range(blocks)) AS block FROM m),
  t AS (SELECT l.*, rep, unnest(range(1, 4 * CAST(ceil(length * p + 8 * sqrt(length * p + 1) + 40) AS BIGINT))) AS k FROM l, range({reps or 1}) z(rep)),
  h AS (SELECT *, sum(CAST(floor(ln(1 - {UNIFORM.format(key)}) / ln(1 - p)) AS BIGINT) + 1) OVER (PARTITION BY rep, a, b, block ORDER BY k) - 1 AS place FROM t),
  f AS (SELECT *, block * length + place AS cell FROM h WHERE place < length AND block * length + place < cells),
  e AS (SELECT rep, least(i.id, j.id) AS src, greatest(i.id, j.id) AS dst FROM f JOIN g i ON i.k = a AND i.r = cell // n_b JOIN g j ON j.k = b AND j.r = cell % n_b
    WHERE (a < b OR cell // n_b < cell % n_b) AND {UNIFORM.format(pair)} * p < 1 / (1 + exp(-(i.mu + j.mu))))"""


@query(f"WITH {_sample_sql(21)} SELECT src, dst FROM e")
def sample_graph_customer(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_graph(customer(spark, d), seed=21, width=WIDTH)


@query(f"WITH {_sample_sql(22, 4)}, b AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT id, count(*) / 4.0::DOUBLE AS degree FROM b GROUP BY id")
def sample_graph_mean_degree(spark: SparkSession, d: str) -> DataFrame:
    return sampling.graph_degrees(customer(spark, d), seed=22, replicates=4, width=WIDTH).select("id", (F.col("total") / 4.0).alias("degree"))


# Motifs by classes of mu

def _grid(fine: bool) -> str:
    """mu of a customer in steps of 0.01 or of 0.1."""
    return "floor(c_acctbal / 50) / 100 - 3" if fine else "floor(c_acctbal / 500) / 10 - 3"


def gridded(spark: SparkSession, d: str, fine: bool) -> Ensemble:
    return Ensemble.heterogeneous(nodes(read(spark, d, "customer"), "c_custkey", _grid(fine)))


def _classes_sql(fine: bool) -> str:
    """n, its classes k, and pairs of them: p, w nodes in the second, v of them other than the focal one; sums of rows by class."""
    return f"""n AS (SELECT c_custkey AS id, {_grid(fine)} AS mu FROM customer), k AS (SELECT mu, count(*) AS w FROM n GROUP BY mu),
  kp AS MATERIALIZED (SELECT a.mu AS a, b.mu AS b, b.w AS w, b.w - (a.mu = b.mu)::INT AS v, 1 / (1 + exp(-(a.mu + b.mu))) AS p FROM k a CROSS JOIN k b),
  kd AS MATERIALIZED (SELECT a, sum(v * p) AS d FROM kp GROUP BY a)"""


#: Paths i, j, k over distinct nodes, with how many there are of each combination of classes.
THREE = """three AS (SELECT x.a, x.v * (z.w - (z.b = x.a)::INT - (z.b = x.b)::INT) AS ways, x.p AS ij, y.p AS jk, z.p AS ik, di.d AS di, dk.d AS dk
    FROM kp x JOIN kp y ON y.a = x.b JOIN kp z ON z.a = x.a AND z.b = y.b JOIN kd di ON di.a = x.a JOIN kd dk ON dk.a = z.b),
  of3 AS MATERIALIZED (SELECT a, sum(ways * ij * jk * ik) / 2 AS t, sum(ways * ij * ik) AS tw, sum(ways * ij * jk) AS th, sum(ways * ij * jk * (di - ij - ik)) AS qw, sum(ways * ij * jk * (dk - ik - jk)) AS qh FROM three GROUP BY a)"""
FOUR = """of4 AS MATERIALIZED (SELECT ij.a, sum(ij.v * (ik.w - (ik.b = ij.a)::INT - (ik.b = ij.b)::INT) * (il.w - (il.b = ij.a)::INT - (il.b = ij.b)::INT - (il.b = ik.b)::INT)
      * ij.p * jk.p * (1 - ik.p) * kl.p * il.p * (1 - jl.p)) / 2 AS q
    FROM kp ij JOIN kp ik ON ik.a = ij.a JOIN kp il ON il.a = ij.a JOIN kp jk ON jk.a = ij.b AND jk.b = ik.b JOIN kp kl ON kl.a = ik.b AND kl.b = il.b JOIN kp jl ON jl.a = ij.b AND jl.b = il.b GROUP BY ij.a)"""


def _motifs(name: str, motifs: tuple[str, ...], fine: bool, columns: dict[str, str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(stats.motifs(gridded(spark, d, fine).nodes, motifs, mc=False, by="classes").select("id", *motifs))

    with_ = f"{_classes_sql(fine)}, {THREE}" if "q" not in columns.values() else f"{_classes_sql(fine)}, {FOUR}"
    table = "of4" if "q" in columns.values() else "of3"
    query(f"WITH {with_} SELECT n.id, {', '.join(_r(columns[m], m) for m in motifs)} FROM n JOIN {table} ON {table}.a = n.mu", name=name)(run)


_motifs("triangle_customer", ("triangle",), True, {"triangle": "t"})
_motifs("paths_customer", ("twedge", "thead", "qwedge", "qhead"), True, {"twedge": "tw", "thead": "th", "qwedge": "qw", "qhead": "qh"})
_motifs("quadrangle_customer", ("quadrangle",), False, {"quadrangle": "q"})


@query(f"WITH {_classes_sql(True)}, {THREE} SELECT n.id, {', '.join(_r(_COEF_SQL[c], c) for c in ('tclust', 'tclosure', 'similarity'))} FROM n JOIN of3 ON of3.a = n.mu")
def tstats_customer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.tstats(gridded(spark, d, True).nodes, mc=False, by="classes").select("id", "tclust", "tclosure", "similarity"))


@query(f"WITH {_classes_sql(False)}, {THREE}, {FOUR} SELECT n.id, {', '.join(_r(_COEF_SQL[c], c) for c in ('qclust', 'qclosure', 'complementarity'))} FROM n JOIN of3 ON of3.a = n.mu JOIN of4 ON of4.a = n.mu")
def qstats_customer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.qstats(gridded(spark, d, False).nodes, mc=False, by="classes").select("id", "qclust", "qclosure", "complementarity"))


# Monte Carlo by classes: the class that a draw falls on, in order of mu

DRAWS = 10


def _mc_sql(fine: bool, seed: int, repeat: int = 1) -> str:
    """Tables up to x(id, mu, rep, r, b, p, total, di, dj, common, mj, sj): each draw with what its class is worth."""
    return f"""{_classes_sql(fine)}, ks AS (SELECT kp.a, sum(v * p * p) AS s, sum(v * p * d.d) AS m FROM kp JOIN kd d ON d.a = kp.b GROUP BY kp.a),
  c0 AS (SELECT a, b, p, sum(v * p) OVER (PARTITION BY a ORDER BY b) AS upto FROM kp WHERE v * p > 0),
  c1 AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY a ORDER BY b) AS below, max(upto) OVER (PARTITION BY a) AS total FROM c0),
  u AS (SELECT id, mu, rep, r, {UNIFORM.format(f"'{seed}:' || id || ':' || rep || ':' || r")} AS u FROM n, range({repeat}) y(rep), range({DRAWS}) z(r)),
  both_ AS (SELECT x.a, x.b, sum((y.w - (y.b = x.a)::INT - (y.b = x.b)::INT) * y.p * z.p) AS common FROM kp x JOIN kp y ON y.a = x.a JOIN kp z ON z.a = x.b AND z.b = y.b GROUP BY x.a, x.b),
  x AS MATERIALIZED (SELECT u.id, u.mu, u.rep, u.r, c1.b, c1.p, c1.total, di.d AS di, dj.d AS dj, common, sj.m AS mj, sj.s AS sj
    FROM u JOIN c1 ON c1.a = u.mu AND u.u >= below / total AND u.u < upto / total JOIN kd di ON di.a = u.mu JOIN kd dj ON dj.a = c1.b JOIN ks sj ON sj.a = c1.b JOIN both_ ON both_.a = u.mu AND both_.b = c1.b)"""


MC_VALUES = {
    "triangle": "total * common / 2", "twedge": "total * (di - p)", "thead": "total * (dj - p)", "qwedge": "total * ((dj - p) * (di - p) - common)",
    "qhead": "total * (mj - p * di - common - (sj - p * p))",
}
#: Squares: the opposite node's class is drawn from the open neighbours of the first.
MC_SQUARES = f"""w0 AS (SELECT x.id, x.rep, x.r, x.mu AS a, x.b, x.p AS ij, x.total AS total1, jk.b AS k, jk.p AS jk, ik.p AS ik, sum((jk.w - (jk.b = x.mu)::INT - (jk.b = x.b)::INT) * jk.p * (1 - ik.p)) OVER (PARTITION BY x.id, x.rep, x.r ORDER BY jk.b) AS upto,
    (jk.w - (jk.b = x.mu)::INT - (jk.b = x.b)::INT) * jk.p * (1 - ik.p) AS weight FROM x JOIN kp jk ON jk.a = x.b JOIN kp ik ON ik.a = x.mu AND ik.b = jk.b),
  w1 AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY id, rep, r ORDER BY k) AS below, max(upto) OVER (PARTITION BY id, rep, r) AS total FROM w0 WHERE weight > 0),
  u2 AS (SELECT x.id, x.rep, x.r, t, {UNIFORM.format("'{seed}:' || x.id || ':' || x.rep || ':' || x.r || ':' || t")} AS u FROM x, range({DRAWS}) z(t)),
  z AS MATERIALIZED (SELECT w1.* FROM u2 JOIN w1 ON w1.id = u2.id AND w1.rep = u2.rep AND w1.r = u2.r AND u2.u >= below / total AND u2.u < upto / total),
  last AS (SELECT s.a, s.b, s.k, sum((il.w - (il.b = s.a)::INT - (il.b = s.b)::INT - (il.b = s.k)::INT) * il.p * kl.p * (1 - jl.p)) AS l FROM (SELECT DISTINCT a, b, k FROM z) s JOIN kp il ON il.a = s.a JOIN kp kl ON kl.a = s.k AND kl.b = il.b JOIN kp jl ON jl.a = s.b AND jl.b = il.b GROUP BY s.a, s.b, s.k)"""


for _m in stats.TRIANGLE + stats.QUADRANGLE:

    def _mc(spark: SparkSession, d: str, motif: str = _m) -> DataFrame:
        got = stats.motifs(gridded(spark, d, motif != "quadrangle").nodes, (motif,), mc=DRAWS, seed=5, by="classes")
        return rounded(got.select("id", motif))

    if _m in MC_VALUES:
        query(f"WITH {_mc_sql(True, 5)} SELECT id, {_r(f'avg({MC_VALUES[_m]})', _m)} FROM x GROUP BY id", name=f"mc_{_m}_customer")(_mc)
    else:
        query(f"WITH {_mc_sql(False, 5)}, {MC_SQUARES.replace('{seed}', '5')} SELECT id, {_r(f'sum(total1 * total * l) / 2 / {DRAWS * DRAWS}', _m)} FROM z JOIN last USING (a, b, k) GROUP BY id", name=f"mc_{_m}_customer")(_mc)


@query(f"""WITH {_mc_sql(True, 6, 2)}, g AS (SELECT id, rep, {', '.join(f'avg({MC_VALUES[m]}) AS {a}' for m, a in (('triangle', 't'), ('twedge', 'tw'), ('thead', 'th')))} FROM x GROUP BY id, rep)
  SELECT id, CAST(rep AS INT) AS rep, {', '.join(_r(_COEF_SQL[c], c) for c in ('tclust', 'tclosure', 'similarity'))} FROM g""")
def mc_tstats_customer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.tstats(gridded(spark, d, True).nodes, mc=DRAWS, seed=6, repeat=2, average=False, by="classes").select("id", "rep", "tclust", "tclosure", "similarity"))


# Interpolated sums of continuous parameters

TOLERANCE = 1e-9


@query(f"WITH {N_CUSTOMER}, {P}, {D} SELECT i AS id, {_r('d', 'degree')} FROM d")
def degree_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(customer(spark, d).nodes, tolerance=TOLERANCE).select("id", "degree"))


@query(f"WITH {N_CUSTOMER}, {P} SELECT i AS id, {_r('sum(ln(1 - p)) / 2', 'free_energy')} FROM p GROUP BY i")
def node_free_energy_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.node_free_energy(customer(spark, d).nodes, tolerance=TOLERANCE).select("id", "free_energy"))


@query(f"WITH {N_CUSTOMER}, {P}, {D} SELECT i AS id, {_r('-d', 'gradient')} FROM d")
def free_energy_gradient_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.free_energy_gradient(customer(spark, d).nodes, tolerance=TOLERANCE).select("id", "gradient"))


@query(f"WITH {N_CUSTOMER}, {P} SELECT {_r('sum(p)', 'edge_count')}, {_r('avg(p)', 'edge_density')}, {_r('sum(ln(1 - p))', 'free_energy')}, {_r('-sum(ln(1 - p))', 'log_partition')} FROM p WHERE i < j")
def graph_sums_interpolated(spark: SparkSession, d: str) -> DataFrame:
    m = customer(spark, d)
    parts = [stats.edge_count(m, tolerance=TOLERANCE), stats.edge_density(m, tolerance=TOLERANCE), stats.free_energy(m, tolerance=TOLERANCE), stats.log_partition(m, tolerance=TOLERANCE)]
    out = parts[0]
    for x in parts[1:]:  # one row each
        out = out.crossJoin(x)
    return rounded(out)


# Fits by distributed L-BFGS steps

@query(f"WITH {GRAPH} SELECT id, CAST(k AS DOUBLE) AS degree FROM k")
def fit_degrees_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Expected degrees under the fit, which are the observed ones."""
    mu, solution = fit.fit_degrees(*graph(spark, d), newton_classes=1)
    if not solution.converged:
        raise RuntimeError(f"no convergence in {solution.iterations} steps")
    mu = observed.cut(mu)
    expected = stats.degree(Ensemble.heterogeneous(mu.where("mu is not null").select("id", "mu")).nodes).select("id", "degree")
    return mu.select("id").join(expected, "id", "left").select("id", F.round(F.coalesce("degree", F.lit(0.0)), 3).alias("degree"))


# Gradients of sums of counts by each node's mu

for _name, _sql in {
    "twedge": "sum(ways * ij * (1 - ij) * 2 * (ik + jk))",
    "triangle": "3 * sum(ways * ij * (1 - ij) * jk * ik)",
}.items():

    def _gradient(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        return rounded(stats.motif_gradient(gridded(spark, d, True).nodes, name).select("id", "gradient"))

    query(f"WITH {_classes_sql(True)}, {THREE}, g AS (SELECT a, {_sql} AS gradient FROM three GROUP BY a) SELECT n.id, {_r('gradient', 'gradient')} FROM n JOIN g ON g.a = n.mu", name=f"{_name}_gradient")(_gradient)


@query(f"WITH {N_CUSTOMER}, {P} SELECT i AS id, {_r('sum(2 * p * (1 - p))', 'gradient')} FROM p GROUP BY i")
def degree_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.motif_gradient(customer(spark, d).nodes, "degree").select("id", "gradient"))


# Integrals of many parameters, path lengths by sketches

@query(f"WITH {_QUAD}, {N_SUPPLIER} SELECT a.id, {_r(f'sum(w * {_density_sql(2, _R2, "g")} * {_union_sql("g", 2, _R2, "a.mu + b.mu")})', 'degree')} FROM n a JOIN n b ON a.id <> b.id CROSS JOIN qd GROUP BY a.id")
def geo_expected_degree_supplier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_TWO.expected_degree(spark, 64, supplier(spark, d).all_nodes, tolerance=1e-9))


@query(ORACLES["obs_avg_path_length"])
def obs_avg_path_length_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of so few nodes are exact."""
    return rounded(observed.average_path_length(*graph(spark, d), lg_k=12))


# Geometric graphs through a tree of cells

_LEVELS, _RADIUS = 3, 10.0
_NEAR = geometry.GeometricModel.of(1500, geometry.Sphere(2, _RADIUS), geometry.Layer("similarity", mu=0.2, beta=2.5))


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    """Customers on a sphere: the height by their balance, the turn by their number."""
    z = F.expr("(c_acctbal + 1000) / 5500 - 1")
    wide, turn = F.sqrt(1 - z * z) * _RADIUS, F.col("c_custkey") * 2.399963
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(wide * F.cos(turn), wide * F.sin(turn), z * _RADIUS).alias("x"))


def _cells_sql(seed: int) -> str:
    """Tables up to e(src, dst): cells of each level, pairs of them that are split or kept, jumps, and the candidates that are edges."""
    r, p = _RADIUS, lambda g: _layer_sql("similarity", g, 2, _RADIUS, "0.2", 2.5)
    at = lambda i: f"CAST(least(greatest(floor((x{i} + {r}) / {2 * r} * {1 << _LEVELS}), 0), {(1 << _LEVELS) - 1}) AS INT)"
    digit = lambda k: " + ".join(f"(({at(i)} >> {_LEVELS - k}) & 1) * {1 << i}" for i in range(3))
    arc = lambda c: f"{2 * r} * asin(least(1, {c} / {2 * r}))"
    gap = " + ".join(f"pow(greatest(0, a.l{i} - b.h{i}, b.l{i} - a.h{i}), 2)" for i in range(3))
    span = " + ".join(f"pow(greatest(a.h{i}, b.h{i}) - least(a.l{i}, b.l{i}), 2)" for i in range(3))
    box = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in range(3))
    sql = f"""z AS (SELECT c_custkey AS id, (c_acctbal + 1000) / 5500 - 1 AS z, c_custkey * 2.399963::DOUBLE AS t FROM customer),
  pts AS (SELECT id, sqrt(1 - z * z) * {r} * cos(t) AS x0, sqrt(1 - z * z) * {r} * sin(t) AS x1, z * {r} AS x2 FROM z),
  g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path, id) - 1 AS g FROM (SELECT *, {" || ".join(f"({digit(k)})" for k in range(1, _LEVELS + 1))} AS path FROM pts)),
  pr0 AS (SELECT '' AS a, '' AS b)"""
    for k in range(_LEVELS + 1):
        keep = "TRUE" if k == _LEVELS else f"cells <= {PER_BLOCK} OR (a < b AND (p <= 4 * p_low OR cells * p <= 2))"
        sql += f""",
  c{k} AS MATERIALIZED (SELECT left(path, {k}) AS c, count(*) AS n, min(g) AS s, {box} FROM g GROUP BY 1),
  b{k} AS (SELECT a.c AS a, b.c AS b, a.s AS s_a, b.s AS s_b, b.n AS n_b, a.n * b.n AS cells, greatest({arc(f"sqrt({gap})")} - {1e-7 * r!r}, 0) AS near, least({arc(f"sqrt({span})")} + {1e-7 * r!r}, {math.pi * r!r}::DOUBLE) AS far
    FROM pr{k} JOIN c{k} a ON a.c = pr{k}.a JOIN c{k} b ON b.c = pr{k}.b),
  q{k} AS MATERIALIZED (SELECT *, ({keep}) AS done FROM (SELECT *, least({p("near")} * (1 + 1e-9::DOUBLE), 1) AS p, {p("far")} AS p_low FROM b{k}))"""
        if k < _LEVELS:
            sql += f""",
  pr{k + 1} AS (SELECT x.c AS a, y.c AS b FROM q{k} JOIN (SELECT DISTINCT left(path, {k + 1}) AS c FROM g) x ON left(x.c, {k}) = a JOIN (SELECT DISTINCT left(path, {k + 1}) AS c FROM g) y ON left(y.c, {k}) = b WHERE NOT done AND (a < b OR x.c <= y.c))"""
    kept = " UNION ALL ".join(f"SELECT a, b, s_a, s_b, n_b, cells, p FROM q{k} WHERE done" for k in range(_LEVELS + 1))
    key = f"'{seed}:' || a || ':' || b || ':' || block || ':' || k"
    dot = " + ".join(f"i.x{k} * j.x{k}" for k in range(3))
    return f"""{sql}, q AS ({kept}),
  m AS (SELECT *, CAST(least(greatest(ceil(cells * p / {PER_BLOCK}), 1), cells) AS BIGINT) AS blocks FROM q),
  l AS (SELECT *, CAST(ceil(cells / blocks) AS BIGINT) AS length, unnest(range(blocks)) AS block FROM m),
  t AS (SELECT *, unnest(range(1, 4 * CAST(ceil(length * p + 8 * sqrt(length * p + 1) + 40) AS BIGINT))) AS k FROM l),
  h AS (SELECT *, sum(CASE WHEN p >= 1 THEN 1 ELSE CAST(least(floor(ln(1 - {UNIFORM.format(key)}) / ln(1 - least(p, 0.9999999999::DOUBLE))), 1e15) AS BIGINT) + 1 END) OVER (PARTITION BY a, b, block ORDER BY k) - 1 AS place FROM t),
  f AS (SELECT *, block * length + place AS cell FROM h WHERE place < length AND block * length + place < cells),
  w AS (SELECT p, least(i.id, j.id) AS src, greatest(i.id, j.id) AS dst, {r} * acos(least(1, greatest(-1, ({dot}) / {r * r}))) AS d
    FROM f JOIN g i ON i.g = s_a + cell // n_b JOIN g j ON j.g = s_b + cell % n_b WHERE a < b OR cell // n_b < cell % n_b),
  e AS (SELECT src, dst FROM w WHERE {UNIFORM.format(f"'{seed}:' || src || ':' || dst")} * p < {p("d")})"""


@query(f"WITH {_cells_sql(31)} SELECT src, dst FROM e")
def geo_sample_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.sample(_NEAR, customer_points(spark, d), seed=31, levels=_LEVELS)


# Sampled sums over paths: each node's cumulative weights are stored once


def _paths_sql(last: bool) -> str:
    """Paths i, j, k of 12 draws at each depth, and the value of triangles; last: whether k may be j only."""
    key = lambda parts: UNIFORM.format(f"'3:' || {parts}")
    distinct = "jk.j <> x.i AND jk.j <> x.j" if last else "jk.j <> x.i"
    return f"""WITH {N_SUPPLIER}, {P}, a AS (SELECT i, j, p, sum(p) OVER w AS upto, sum(p) OVER (PARTITION BY i) AS total FROM p WHERE p > 0 WINDOW w AS (PARTITION BY i ORDER BY j)),
  x AS (SELECT a.*, r, total / p / 12 AS factor FROM a, range(12) t(r) WHERE {key("i || '::' || r")} >= (upto - p) / total AND {key("i || '::' || r")} < upto / total),
  b AS (SELECT x.i, x.j, x.r, x.p AS ij, x.factor, jk.j AS k, jk.p, sum(jk.p) OVER w AS upto, sum(jk.p) OVER (PARTITION BY x.i, x.r) AS total FROM x JOIN p jk ON jk.i = x.j AND jk.p > 0 AND {distinct} WINDOW w AS (PARTITION BY x.i, x.r ORDER BY jk.j)),
  y AS (SELECT b.*, total / p / 12 AS other FROM b, range(12) t(s) WHERE {key("i || ':/' || r || ':' || s")} >= (upto - p) / total AND {key("i || ':/' || r || ':' || s")} < upto / total)
  SELECT y.i AS id, {_r('sum(y.factor * y.other * y.ij * y.p * ik.p / 2)', 'value')} FROM y JOIN p ik ON ik.i = y.i AND ik.j = y.k GROUP BY y.i"""


_TRIANGLE = lambda i, j, k: _PP(i, j) * _PP(j, k) * _PP(i, k) / 2


@query(_paths_sql(True))
def mc_iterate_ranged(spark: SparkSession, d: str) -> DataFrame:
    return rounded(iteration.iterate_ranged(supplier(spark, d).nodes, 2, _TRIANGLE, _PP, 12, seed=3))


@query(_paths_sql(False))
def mc_iterate_earlier(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness against earlier nodes but the last, whose weight to itself is 0."""
    return rounded(iteration.iterate_ranged(supplier(spark, d).nodes, 2, _TRIANGLE, _PP, 12, seed=3, unique="earlier"))
