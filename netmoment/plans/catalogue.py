"""Named queries of (spark, sf_dir) and, written from the literal definitions, their DuckDB SQL.

Doubles are rounded to 6 decimals on both sides; undefined values are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.random import RandomGenerator
from ..functions.variables import Constraint
from ..operators import fit, geometry, grids, iteration, observed, sampling, stats
from ..sources.graphs import canonical, edges_by_slots, from_matrix_rows, nodes, read
from .model import Ensemble

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, without a negative zero; NaN and infinities are null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(E.INF)), F.lit(None).cast("double")).otherwise(F.round(c, 6) + F.lit(0.0))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def supplier(spark: SparkSession, d: str) -> Ensemble:
    return Ensemble.heterogeneous(nodes(read(spark, d, "supplier"), "s_suppkey", "s_acctbal / 5000 - 2"))


def customer(spark: SparkSession, d: str) -> Ensemble:
    return Ensemble.heterogeneous(nodes(read(spark, d, "customer"), "c_custkey", "c_acctbal / 5000 - 3"))


def nation(spark: SparkSession, d: str) -> Ensemble:
    return Ensemble.heterogeneous(nodes(read(spark, d, "nation"), "n_nationkey", "n_regionkey * 0.4D - 1.2D"))


def mean_of(spark: SparkSession, d: str, table: str, expression: str) -> float:
    """The mean of an expression over a table, a parameter of a model."""
    return read(spark, d, table).agg(F.avg(F.expr(expression))).first()[0]


def standard(spark: SparkSession, d: str) -> Ensemble:
    """A homogeneous model of as many nodes as there are suppliers, with their mean mu."""
    return Ensemble.homogeneous(spark, read(spark, d, "supplier").count(), mean_of(spark, d, "supplier", "s_acctbal / 5000 - 2"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").cast("long").alias("id")).distinct()


def graph(spark: SparkSession, d: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    return users(spark, d), edges_by_slots(read(spark, d, "events"), least)


def points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


# SQL parts

HOMOGENEOUS = "v AS (SELECT count(*) AS n, 1 / (1 + exp(-avg(s_acctbal / 5000 - 2))) AS p FROM supplier)"
N_SUPPLIER = "n AS (SELECT s_suppkey AS id, s_acctbal / 5000 - 2 AS mu FROM supplier)"
N_CUSTOMER = "n AS (SELECT c_custkey AS id, c_acctbal / 5000 - 3 AS mu FROM customer)"
N_NATION = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) * 0.4::DOUBLE - 1.2::DOUBLE AS mu FROM nation)"
P = "p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.mu + b.mu AS m, CASE WHEN a.id = b.id THEN 0 ELSE 1 / (1 + exp(-(a.mu + b.mu))) END AS p FROM n a CROSS JOIN n b)"
D = "d AS MATERIALIZED (SELECT i, sum(p) AS d FROM p GROUP BY i)"
#: Literal motif sums over distinct nodes.
T = "t AS MATERIALIZED (SELECT x.i, sum(x.p * y.p * z.p) / 2 AS t FROM p x JOIN p y ON y.i = x.j JOIN p z ON z.i = y.j AND z.j = x.i GROUP BY x.i)"
TW = "tw AS MATERIALIZED (SELECT p.i, sum(p.p * (d.d - p.p)) AS tw FROM p JOIN d ON p.i = d.i WHERE p.i <> p.j GROUP BY p.i)"
TH = "th AS MATERIALIZED (SELECT p.i, sum(p.p * (d.d - p.p)) AS th FROM p JOIN d ON p.j = d.i WHERE p.i <> p.j GROUP BY p.i)"
QW = "qw AS MATERIALIZED (SELECT x.i, sum(x.p * y.p * (d.d - x.p - z.p)) AS qw FROM p x JOIN p y ON y.i = x.j AND y.j <> x.i JOIN p z ON z.i = x.i AND z.j = y.j JOIN d ON d.i = x.i WHERE x.i <> x.j GROUP BY x.i)"
QH = "qh AS MATERIALIZED (SELECT x.i, sum(x.p * y.p * (d.d - z.p - y.p)) AS qh FROM p x JOIN p y ON y.i = x.j AND y.j <> x.i AND y.j <> x.j JOIN p z ON z.i = x.i AND z.j = y.j JOIN d ON d.i = y.j WHERE x.i <> x.j GROUP BY x.i)"
Q = """q AS MATERIALIZED (
  SELECT ij.i, sum(ij.p * jk.p * (1 - ik.p) * kl.p * il.p * (1 - jl.p)) / 2 AS q
  FROM p ij JOIN p jk ON jk.i = ij.j JOIN p ik ON ik.i = ij.i AND ik.j = jk.j JOIN p kl ON kl.i = jk.j JOIN p il ON il.i = ij.i AND il.j = kl.j JOIN p jl ON jl.i = ij.j AND jl.j = kl.j
  WHERE ij.i <> ij.j AND jk.j NOT IN (ij.i, ij.j) AND kl.j NOT IN (ij.i, ij.j, jk.j) GROUP BY ij.i)"""
RATIO = "least(1, greatest(0, {0} / nullif({1}, 0)))"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


# Pairs

for _name, _column, _sql in (
    ("pair_coupling", "coupling", "CASE WHEN i <> j THEN -m END"),
    ("pair_probs", "p", "p"),
    ("pair_log_probs", "p", "CASE WHEN i <> j THEN -(greatest(-m, 0) + ln(1 + exp(-abs(m)))) END"),
    ("pair_free_energy", "fe", "CASE WHEN i = j THEN 0 ELSE -(greatest(m, 0) + ln(1 + exp(-abs(m)))) END"),
):

    def _pair(spark: SparkSession, d: str, name: str = _name, column: str = _column) -> DataFrame:
        v = supplier(spark, d).pairs
        got = {"pair_coupling": v.couplings, "pair_probs": v.probs, "pair_log_probs": lambda: v.probs(log=True), "pair_free_energy": v.free_energy}[name]()
        return rounded(got.select("i", "j", column))

    query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r(_sql, _column)} FROM p", name=_name)(_pair)


@query(f"WITH {N_SUPPLIER}, {P}, s AS (SELECT * FROM (VALUES (0, 1, 2), (1, 3, 3), (2, 5, 1), (3, 1, 2)) v(pos, i, j)) SELECT CAST(s.pos AS BIGINT) AS pos, p.i, p.j, {_r('p.p', 'p')} FROM s JOIN p ON p.i = s.i AND p.j = s.j")
def pairs_pointwise(spark: SparkSession, d: str) -> DataFrame:
    got = supplier(spark, d).pairs[[1, 3, 5, 1], [2, 3, 1, 2]].probs()
    return rounded(got.select(F.col("pos_i").alias("pos"), "i", "j", "p"))


@query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r('p', 'p')} FROM p WHERE i IN (1, 3, 5) AND j IN (2, 3)")
def pairs_outer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).pairs.outer([1, 3, 5], [2, 3]).probs().select("i", "j", "p"))


@query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r('p', 'p')} FROM p WHERE i = 2")
def pairs_row(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).pairs[2].probs().select("i", "j", "p"))


@query(f"WITH {N_SUPPLIER}, {P} SELECT DISTINCT i AS id FROM p WHERE i IN (1, 2, 3, 5)")
def pairs_nodes(spark: SparkSession, d: str) -> DataFrame:
    return supplier(spark, d).pairs[[1, 3, 5], [2, 3, 1]].nodes()


@query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r('p', 'p')} FROM p WHERE i <= 4 AND j <= 4")
def nodes_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[:5].induced_pairs().probs().select("i", "j", "p"))


# Node views

@query(f"WITH {N_SUPPLIER} SELECT id, {_r('mu', 'mu')} FROM n WHERE id >= 2 AND id < (SELECT max(id) + 1 FROM n) - 2 AND (id - 2) % 2 = 0")
def nodes_slice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[2:-2:2].rows().select("id", "mu"))


@query(f"WITH {N_SUPPLIER} SELECT id, {_r('mu', 'mu')} FROM n WHERE mu > -1")
def nodes_mask(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[F.col("mu") > -1].rows().select("id", "mu"))


@query(f"WITH {N_SUPPLIER}, s AS (SELECT * FROM (VALUES (0, 5), (1, 1), (2, 5), (3, 3)) v(pos, id)) SELECT CAST(pos AS BIGINT) AS pos, n.id, {_r('mu', 'mu')} FROM s JOIN n ON s.id = n.id")
def nodes_take_dups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[[5, 1, 5, 3]].rows())


@query(f"WITH {N_SUPPLIER}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, mu FROM n WHERE mu > -1), {P.replace('FROM n a CROSS JOIN n b', 'FROM r a CROSS JOIN r b')} SELECT i, j, {_r('p', 'p')} FROM p")
def materialize_probs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[F.col("mu") > -1].materialize().pairs.probs().select("i", "j", "p"))


UNIFORM = "(CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query(f"WITH {N_SUPPLIER} SELECT row_number() OVER (ORDER BY u, id) - 1 AS pos, id, {_r('mu', 'mu')} FROM (SELECT *, {UNIFORM.format("'7:' || id || ':' || id")} AS u FROM n) ORDER BY u, id LIMIT 20")
def sample_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes.sample(20, seed=7))


@query(f"WITH {N_SUPPLIER}, s AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, id, mu FROM n), r AS (SELECT k, floor({UNIFORM.format("'7:' || k")} * (SELECT count(*) FROM n)) AS place FROM range(50) t(k)) SELECT r.k AS pos, s.id, {_r('mu', 'mu')} FROM r JOIN s ON r.place = s.place")
def sample_nodes_replaced(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes.sample(50, seed=7, replace=True))


# Degrees and global statistics

@query(f"WITH {N_SUPPLIER}, {P}, {D} SELECT i AS id, {_r('d', 'degree')} FROM d")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(supplier(spark, d).nodes).select("id", "degree"))


@query(f"WITH {N_CUSTOMER}, {P}, {D} SELECT i AS id, {_r('d', 'degree')} FROM d")
def degree_customer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(customer(spark, d).nodes).select("id", "degree"))


@query(f"WITH {N_SUPPLIER}, {P}, {D}, s AS (SELECT * FROM (VALUES (0, 5), (1, 1), (2, 5)) v(pos, id)) SELECT CAST(pos AS BIGINT) AS pos, id, {_r('d', 'degree')} FROM s JOIN d ON d.i = s.id")
def degree_subset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(supplier(spark, d).nodes[[5, 1, 5]]).select("pos", "id", "degree"))


@query(f"WITH {N_SUPPLIER}, {P}, {D} SELECT i AS id, {_r('d / (SELECT count(*) FROM n)', 'degree')} FROM d")
def degree_normalized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(supplier(spark, d).nodes, normalize=True).select("id", "degree"))


@query(f"WITH {HOMOGENEOUS} SELECT {_r('(n - 1) * p', 'degree')} FROM v")
def degree_homogeneous(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(standard(spark, d).nodes))


@query(f"WITH {HOMOGENEOUS} SELECT CAST(id AS BIGINT) AS id, {_r('(n - 1) * p', 'degree')} FROM v, range(10) t(id)")
def degree_homogeneous_view(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.degree(standard(spark, d).nodes[:10]).select("id", "degree"))


@query(f"WITH {N_SUPPLIER}, {P}, {D} SELECT i AS id, {_r('-d', 'gradient')} FROM d")
def free_energy_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.free_energy_gradient(supplier(spark, d).nodes).select("id", "gradient"))


@query(f"WITH {N_SUPPLIER}, {P} SELECT {_r('sum(p)', 'edge_count')} FROM p WHERE i < j")
def edge_count(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.edge_count(supplier(spark, d)))


@query(f"WITH {N_SUPPLIER}, {P} SELECT {_r('avg(p)', 'edge_density')} FROM p WHERE i < j")
def edge_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.edge_density(supplier(spark, d)))


@query(f"WITH {N_SUPPLIER}, {P} SELECT {_r('sum(ln(1 - p))', 'free_energy')} FROM p WHERE i < j")
def free_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.free_energy(supplier(spark, d)))


@query(f"WITH {N_SUPPLIER}, {P} SELECT {_r('-sum(ln(1 - p))', 'log_partition')} FROM p WHERE i < j")
def log_partition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.log_partition(supplier(spark, d)))


@query(f"WITH {N_SUPPLIER}, {P} SELECT i AS id, {_r('sum(ln(1 - p)) / 2', 'free_energy')} FROM p GROUP BY i")
def node_free_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.node_free_energy(supplier(spark, d).nodes).select("id", "free_energy"))


# Motifs and coefficients

def _motif_query(name: str, model: Callable, with_: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        motif = name.removesuffix("_nation")
        return rounded(stats.motifs(model(spark, d).nodes, (motif,), mc=False).select("id", motif))

    query(f"WITH {with_} SELECT i AS id, {_r(sql, name.removesuffix('_nation'))} FROM {sql}", name=name)(run)


_motif_query("triangle", supplier, f"{N_SUPPLIER}, {P}, {T}", "t")
_motif_query("twedge", supplier, f"{N_SUPPLIER}, {P}, {D}, {TW}", "tw")
_motif_query("thead", supplier, f"{N_SUPPLIER}, {P}, {D}, {TH}", "th")
_motif_query("qwedge", supplier, f"{N_SUPPLIER}, {P}, {D}, {QW}", "qw")
_motif_query("qhead", supplier, f"{N_SUPPLIER}, {P}, {D}, {QH}", "qh")
_motif_query("quadrangle", nation, f"{N_NATION}, {P}, {Q}", "q")


def _of_supplier(name: str, run: Callable, sql: str) -> None:
    query(sql, name=f"{name}_supplier")(lambda spark, d: rounded(run(supplier(spark, d).nodes, mc=False)))


#: The same sum with the two middle nodes j and l of i and k summed first: all pairs, less equal ones, less those that are adjacent.
QK = """xk AS MATERIALIZED (SELECT ij.i, jk.j AS k, ij.j, ij.p * jk.p AS x FROM p ij JOIN p jk ON jk.i = ij.j WHERE jk.j <> ij.i),
  s AS MATERIALIZED (SELECT i, k, sum(x) AS s, sum(x * x) AS s2 FROM xk GROUP BY i, k),
  a AS MATERIALIZED (SELECT x.i, x.k, sum(x.x * y.x * jl.p) AS adjacent FROM xk x JOIN p jl ON jl.i = x.j JOIN xk y ON y.i = x.i AND y.k = x.k AND y.j = jl.j GROUP BY x.i, x.k),
  q AS MATERIALIZED (SELECT s.i, sum((1 - p.p) * (s.s * s.s - s.s2 - a.adjacent)) / 2 AS q FROM s JOIN a ON a.i = s.i AND a.k = s.k JOIN p ON p.i = s.i AND p.j = s.k GROUP BY s.i)"""
_of_supplier("quadrangle", lambda v, mc: stats.motifs(v, ("quadrangle",), mc=mc).select("id", "quadrangle"), f"WITH {N_SUPPLIER}, {P}, {QK} SELECT i AS id, {_r('q', 'quadrangle')} FROM q")

_T_FROM = f"{N_SUPPLIER}, {P}, {D}, {T}, {TW}, {TH}"
_Q_FROM = f"{N_NATION}, {P}, {D}, {Q}, {QW}, {QH}"
_COEF_SQL = {
    "tclust": RATIO.format("2 * t", "tw"), "tclosure": RATIO.format("2 * t", "th"), "similarity": RATIO.format("4 * t", "(tw + th)"),
    "qclust": RATIO.format("2 * q", "qw"), "qclosure": RATIO.format("2 * q", "qh"), "complementarity": RATIO.format("4 * q", "(qw + qh)"),
}


def _coefficient_query(name: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        view = (supplier if columns[0] in ("tclust", "tclosure", "similarity") else nation)(spark, d).nodes
        return rounded(stats.coefficients(view, columns, mc=False).select("id", *columns))

    tables = "t JOIN tw ON t.i = tw.i JOIN th ON t.i = th.i" if columns[0] in ("tclust", "tclosure", "similarity") else "q t JOIN qw ON t.i = qw.i JOIN qh ON t.i = qh.i"
    query(f"WITH {_T_FROM if ' tw ' in tables else _Q_FROM} SELECT t.i AS id, {', '.join(_r(_COEF_SQL[c], c) for c in columns)} FROM {tables}", name=name)(run)


for _c in _COEF_SQL:
    _coefficient_query(_c, (_c,))
_coefficient_query("tstats", ("tclust", "tclosure", "similarity"))
_coefficient_query("qstats", ("qclust", "qclosure", "complementarity"))
_of_supplier(
    "qstats",
    lambda v, mc: stats.qstats(v, mc=mc).select("id", "qclust", "qclosure", "complementarity"),
    f"WITH {N_SUPPLIER}, {P}, {D}, {QK}, {QW}, {QH} SELECT t.i AS id, {', '.join(_r(_COEF_SQL[c], c) for c in ('qclust', 'qclosure', 'complementarity'))} FROM q t JOIN qw ON t.i = qw.i JOIN qh ON t.i = qh.i",
)


@query(f"""WITH {HOMOGENEOUS}, c AS (SELECT p, (n - 1) * (n - 2) AS three, (n - 1) * (n - 2) * (n - 3) AS four FROM v) SELECT round(three * p ** 3 / 2, 6) AS triangle, round(three * p ** 2, 6) AS twedge, round(three * p ** 2, 6) AS thead,
  round(four * p ** 4 * (1 - p) ** 2 / 2, 6) AS quadrangle, round(four * p ** 3, 6) AS qwedge, round(four * p ** 3, 6) AS qhead FROM c""")
def motifs_homogeneous(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.motifs(standard(spark, d).nodes))


@query(f"WITH {HOMOGENEOUS} SELECT round(p, 6) AS tclust, round(p, 6) AS tclosure, round(p, 6) AS similarity, round(p * (1 - p) ** 2, 6) AS qclust, round(p * (1 - p) ** 2, 6) AS qclosure, round(p * (1 - p) ** 2, 6) AS complementarity FROM v")
def coefs_homogeneous(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.coefficients(standard(spark, d).nodes, tuple(stats.COEFFICIENTS)))


# Monte Carlo: draws are hashes, so SQL draws the same neighbours

DRAWS, REPEAT = 10, 2
#: The draws of each node and repetition, the neighbour that each falls on, and the sums of rows that motifs take of it.
MC = f"""c AS MATERIALIZED (SELECT i, j, p, sum(p) OVER (PARTITION BY i ORDER BY j) AS upto, sum(p) OVER (PARTITION BY i) AS total FROM p),
  u AS (SELECT id AS i, rep, r, {UNIFORM.format("'5:' || id || ':' || rep || ':' || r")} AS u FROM n, range({{repeat}}) a(rep), range({DRAWS}) b(r)),
  x AS MATERIALIZED (SELECT u.i, u.rep, u.r, c.j, c.p, c.total FROM u JOIN c ON u.i = c.i AND u.u * c.total >= c.upto - c.p AND u.u * c.total < c.upto),
  y AS MATERIALIZED (SELECT x.i, x.rep, x.r, any_value(x.j) AS j, any_value(x.p) AS p, any_value(x.total) AS total, any_value(di.d) AS di, any_value(dj.d) AS dj, sum(jk.p * ik.p) AS both_, sum(CASE WHEN jk.j <> x.i THEN jk.p * (dk.d - ik.p - jk.p) ELSE 0 END) AS paths
    FROM x JOIN p jk ON jk.i = x.j JOIN p ik ON ik.i = x.i AND ik.j = jk.j JOIN d di ON di.i = x.i JOIN d dj ON dj.i = x.j JOIN d dk ON dk.i = jk.j GROUP BY x.i, x.rep, x.r)"""
MC_SQL = {
    "triangle": "total * both_ / 2", "twedge": "total * (di - p)", "thead": "total * (dj - p)", "qwedge": "total * ((dj - p) * (di - p) - both_)", "qhead": "total * paths",
}
MC_QUADRANGLE = f"""w AS MATERIALIZED (SELECT x.i, x.r, x.j, x.total, jk.j AS k, CASE WHEN jk.j = x.i THEN 0 ELSE jk.p * (1 - ik.p) END AS w FROM x JOIN p jk ON jk.i = x.j JOIN p ik ON ik.i = x.i AND ik.j = jk.j),
  e AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY i, r ORDER BY k) AS upto, sum(w) OVER (PARTITION BY i, r) AS edge FROM w),
  v AS (SELECT i, r, s, {UNIFORM.format("'5:' || i || ':0:' || r || ':' || s")} AS u FROM x, range({DRAWS}) b(s)),
  z AS MATERIALIZED (SELECT e.* FROM v JOIN e ON v.i = e.i AND v.r = e.r AND v.u * e.edge >= e.upto - e.w AND v.u * e.edge < e.upto),
  q AS (SELECT z.i, sum(z.total * z.edge * kl.p * il.p * CASE WHEN kl.j = z.j THEN 0 WHEN kl.j = z.i THEN 1 ELSE 1 - jl.p END) / 2 / {DRAWS * DRAWS} AS q
    FROM z JOIN p kl ON kl.i = z.k JOIN p il ON il.i = z.i AND il.j = kl.j JOIN p jl ON jl.i = z.j AND jl.j = kl.j GROUP BY z.i)"""

for _m in stats.TRIANGLE + stats.QUADRANGLE:

    def _mc(spark: SparkSession, d: str, motif: str = _m) -> DataFrame:
        return rounded(stats.motifs(supplier(spark, d).nodes, (motif,), mc=DRAWS, seed=5).select("id", motif))

    if _m in MC_SQL:
        query(f"WITH {N_SUPPLIER}, {P}, {D}, {MC.format(repeat=1)} SELECT i AS id, {_r(f'avg({MC_SQL[_m]})', _m)} FROM y GROUP BY i", name=f"mc_{_m}")(_mc)
    else:
        query(f"WITH {N_SUPPLIER}, {P}, {D}, {MC.format(repeat=1)}, {MC_QUADRANGLE} SELECT i AS id, {_r('q', _m)} FROM q", name=f"mc_{_m}")(_mc)


@query(f"""WITH {N_SUPPLIER}, {P}, {D}, {MC.format(repeat=REPEAT)}, g AS (SELECT i, rep, {', '.join(f'avg({MC_SQL[m]}) AS {a}' for m, a in (('triangle', 't'), ('twedge', 'tw'), ('thead', 'th')))} FROM y GROUP BY i, rep)
  SELECT i AS id, CAST(rep AS INT) AS rep, {', '.join(_r(_COEF_SQL[c], c) for c in ('tclust', 'tclosure', 'similarity'))} FROM g""")
def mc_tstats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.tstats(supplier(spark, d).nodes, mc=DRAWS, seed=5, repeat=REPEAT, average=False).select("id", "rep", "tclust", "tclosure", "similarity"))


# Sampling

EDGES_SAMPLED = f"WITH {N_SUPPLIER}, {P} SELECT i AS src, j AS dst FROM p WHERE i < j AND {UNIFORM.format("'42:' || i || ':' || j")} < p"


@query(EDGES_SAMPLED)
def sample_edges(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_edges(supplier(spark, d), seed=42)


@query(f"""WITH {N_SUPPLIER}, {P}, e AS (SELECT k AS rep, i, j FROM p, range(5) t(k) WHERE i < j AND {UNIFORM.format("'42:' || k || ':' || i || ':' || j")} < p),
  b AS (SELECT rep, i AS id FROM e UNION ALL SELECT rep, j FROM e) SELECT id, CAST(count(*) AS BIGINT) AS total FROM b GROUP BY id""")
def sample_replicates_degree(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_degrees(supplier(spark, d), seed=42, replicates=5)


@query(f"""WITH n AS (SELECT count(*) AS n FROM customer), i AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS src, n FROM customer, n),
  s AS (SELECT src, n, k, floor(ln(1 - {UNIFORM.format("'3:' || src || ':' || k")}) / ln(1 - 1 / (1 + (n - 6) / 5.0))) + 1 AS step FROM i, range(1, 200) b(k)),
  r AS (SELECT src, n, src + sum(step) OVER (PARTITION BY src ORDER BY k) AS dst FROM s) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM r WHERE dst < n""")
def sample_sparse(spark: SparkSession, d: str) -> DataFrame:
    """As many nodes as customers, of mean degree 5."""
    n = read(spark, d, "customer").count()
    return sampling.sample_sparse(Ensemble.homogeneous(spark, n, math.log(5 / (n - 6))), seed=3)


# Observed graphs

def _graph_sql(least: int = 3) -> str:
    return f"""u AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id FROM events), s AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS u, date_trunc('hour', ts) AS h, event_type AS e FROM events),
  g AS MATERIALIZED (SELECT a.u AS src, b.u AS dst FROM s a JOIN s b ON a.h = b.h AND a.e = b.e AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= {least}),
  adj AS MATERIALIZED (SELECT src AS i, dst AS j FROM g UNION ALL SELECT dst, src FROM g), k AS MATERIALIZED (SELECT u.id, count(adj.j) AS k FROM u LEFT JOIN adj ON u.id = adj.i GROUP BY u.id)"""


GRAPH = _graph_sql()
#: Literal counts of paths over distinct nodes.
CENSUS = f"""{GRAPH}, pp AS MATERIALIZED (SELECT x.i, x.j, y.j AS k FROM adj x JOIN adj y ON y.i = x.j WHERE y.j <> x.i),
  ct AS (SELECT i, count(*) // 2 AS t FROM pp JOIN g ON g.src = least(pp.i, pp.k) AND g.dst = greatest(pp.i, pp.k) GROUP BY i),
  ctw AS (SELECT j AS i, count(*) AS tw FROM pp GROUP BY j), cth AS (SELECT i, count(*) AS th FROM pp GROUP BY i),
  ppp AS (SELECT pp.i, pp.j, pp.k, z.j AS l FROM pp JOIN adj z ON z.i = pp.k WHERE z.j <> pp.i AND z.j <> pp.j),
  cqh AS (SELECT i, count(*) AS qh FROM ppp GROUP BY i), cqw AS (SELECT j AS i, count(*) AS qw FROM ppp GROUP BY j),
  cq AS (SELECT i, count(*) // 2 AS q0 FROM ppp WHERE EXISTS (SELECT 1 FROM adj a WHERE a.i = ppp.l AND a.j = ppp.i) AND NOT EXISTS (SELECT 1 FROM adj a WHERE a.i = ppp.i AND a.j = ppp.k)
    AND NOT EXISTS (SELECT 1 FROM adj a WHERE a.i = ppp.j AND a.j = ppp.l) GROUP BY i),
  c AS MATERIALIZED (SELECT u.id, coalesce(t, 0)::BIGINT AS t, coalesce(tw, 0) AS tw, coalesce(th, 0) AS th, coalesce(q0, 0)::BIGINT AS q0, coalesce(qw, 0) AS qw, coalesce(qh, 0) AS qh
    FROM u LEFT JOIN ct ON u.id = ct.i LEFT JOIN ctw ON u.id = ctw.i LEFT JOIN cth ON u.id = cth.i LEFT JOIN cq ON u.id = cq.i LEFT JOIN cqw ON u.id = cqw.i LEFT JOIN cqh ON u.id = cqh.i)"""
_OBS_COEF = {k: v.replace("* q", "* q0").replace("* t", "* t") for k, v in _COEF_SQL.items()}


@query(f"WITH {GRAPH} SELECT id, k AS degree FROM k")
def obs_degree(spark: SparkSession, d: str) -> DataFrame:
    return observed.degree(*graph(spark, d))


@query(f"WITH {_graph_sql(4)} SELECT id, k AS degree FROM k")
def obs_degree_isolated(spark: SparkSession, d: str) -> DataFrame:
    return observed.degree(*graph(spark, d, 4))


@query(f"WITH {GRAPH} SELECT count(*) AS edge_count FROM g")
def obs_edge_count(spark: SparkSession, d: str) -> DataFrame:
    return observed.edge_count(graph(spark, d)[1])


@query(f"WITH {GRAPH}, n AS (SELECT count(*) AS n FROM u) SELECT {_r('2.0 * (SELECT count(*) FROM g) / (n * (n - 1))', 'density')} FROM n")
def obs_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observed.density(*graph(spark, d)))


@query(f"WITH {CENSUS} SELECT * FROM c")
def obs_census(spark: SparkSession, d: str) -> DataFrame:
    return observed.census(*graph(spark, d))


@query(f"WITH {CENSUS} SELECT id, {_r(RATIO.format('2.0 * t', 'tw'), 'transitivity')} FROM c")
def obs_local_transitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observed.coefficients(*graph(spark, d), ("tclust",)).select("id", F.col("tclust").alias("transitivity")))


@query(f"WITH {CENSUS} SELECT id, {', '.join(_r(v, k) for k, v in _OBS_COEF.items())} FROM c")
def obs_coefs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observed.coefficients(*graph(spark, d)))


@query(f"WITH {CENSUS}, tot AS (SELECT sum(t) AS t, sum(tw) AS tw, sum(th) AS th, sum(q0) AS q0, sum(qw) AS qw, sum(qh) AS qh FROM c) SELECT {', '.join(_r(v, k) for k, v in _OBS_COEF.items())} FROM tot")
def obs_global_coefs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observed.global_coefficients(*graph(spark, d)))


@query(f"""WITH RECURSIVE {GRAPH}, r(i, j, d) AS (SELECT i, j, 1 FROM adj UNION SELECT r.i, adj.j, r.d + 1 FROM r JOIN adj ON adj.i = r.j WHERE r.d < 12 AND adj.j <> r.i),
  m AS (SELECT i, j, min(d) AS d FROM r GROUP BY i, j) SELECT {_r('avg(d)', 'average_path_length')} FROM m""")
def obs_avg_path_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observed.average_path_length(*graph(spark, d)))


# Fits

@query(f"WITH {GRAPH}, n AS (SELECT count(*) AS n FROM u), q AS (SELECT 2.0 * (SELECT count(*) FROM g) / (n * (n - 1)) AS p FROM n) SELECT {_r('ln(p / (1 - p))', 'mu')} FROM q")
def fit_homogeneous(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.homogeneous_mu(*graph(spark, d)))


CHUNG_LU = f"{GRAPH}, n AS MATERIALIZED (SELECT id, ln(k / sqrt((SELECT sum(k) FROM k))) AS mu, k FROM k WHERE k > 0)"


@query(f"WITH {CHUNG_LU} SELECT u.id, {_r('mu', 'mu')} FROM u LEFT JOIN n ON u.id = n.id")
def fit_init_chung_lu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.initial(*graph(spark, d), "cm"))


@query(f"WITH {GRAPH} SELECT id, {_r(f'1 - 2 * {UNIFORM.format(chr(39) + "9:" + chr(39) + " || id")}', 'mu')} FROM u")
def fit_init_random(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.initial(*graph(spark, d), "random", seed=9))


def _fitted(spark: SparkSession, d: str, least: int) -> DataFrame:
    mu, _ = fit.fit_degrees(*graph(spark, d, least))
    mu = observed.cut(mu)
    expected = stats.degree(Ensemble.heterogeneous(mu.where("mu is not null").select("id", "mu")).nodes).select("id", "degree")
    return mu.select("id").join(expected, "id", "left").select("id", F.round(F.coalesce("degree", F.lit(0.0)), 3).alias("degree"))


@query(f"WITH {GRAPH} SELECT id, CAST(k AS DOUBLE) AS degree FROM k")
def fit_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, 3)


@query(f"WITH {_graph_sql(4)} SELECT id, CAST(k AS DOUBLE) AS degree FROM k")
def fit_degrees_isolated(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, 4)


def _start(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids, edges = graph(spark, d)
    return fit.initial(ids, edges, "cm"), ids, edges


_PAIR_MU = "pr AS (SELECT a.id AS i, b.id AS j, a.mu + b.mu AS m FROM n a JOIN n b ON a.id < b.id)"


@query(f"WITH {CHUNG_LU} SELECT {_r('-sum(mu * k)', 'hamiltonian')} FROM n")
def hamiltonian(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.hamiltonian(*_start(spark, d)))


@query(f"WITH {CHUNG_LU}, {_PAIR_MU} SELECT {_r('-(SELECT sum(mu * k) FROM n) + sum(ln(1 + exp(m)))', 'lagrangian')} FROM pr")
def lagrangian(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.lagrangian(*_start(spark, d)))


@query(f"WITH {CHUNG_LU}, {_PAIR_MU} SELECT {_r('sum(CASE WHEN g.src IS NOT NULL THEN -ln(1 + exp(-m)) ELSE -ln(1 + exp(m)) END)', 'log_likelihood')} FROM pr LEFT JOIN g ON g.src = pr.i AND g.dst = pr.j")
def log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.log_likelihood(*_start(spark, d)))


# Spheres and geometric models

_DOT = "list_sum(list_transform(list_zip(a.x, b.x), lambda v: v[1] * v[2]))"
_POINTS = "pts AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
_G = f"acos(least(1, greatest(-1, {_DOT})))"
_GS = f"{_POINTS}, gs AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {_G} AS g FROM pts a JOIN pts b ON a.id < b.id)"


@query(f"WITH {_GS} SELECT i, j, {_r('g', 'g')} FROM gs")
def sphere_distances(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return rounded(geometry.distances(p, geometry.Sphere(63)))


def _density_sql(dim: int, r: float, g: str) -> str:
    c = math.gamma((dim + 1) / 2) / (math.sqrt(math.pi) * math.gamma(dim / 2) * r)
    return f"({c!r}::DOUBLE * greatest(sin({g} / {r!r}::DOUBLE), 0) ** {dim - 1})"


@query(f"WITH {_POINTS}, o AS (SELECT id, list_transform(x, lambda v: -v) AS x FROM pts) SELECT a.id AS i, b.id AS j, {_r(_G, 'g')} FROM pts a CROSS JOIN o b")
def sphere_antipode_distances(spark: SparkSession, d: str) -> DataFrame:
    """Of all points to the antipodes of all points."""
    p = points(spark, d)
    return rounded(geometry.distances(p, geometry.Sphere(63), other=p.select("id", F.transform("x", lambda v: -v).alias("x"))))


#: A customer's balance, as a part of its range.
_SHARE = "((c_acctbal + 1000) / 11000)"


@query(f"SELECT c_custkey AS id, {_r(_density_sql(4, 2.0, f'({_SHARE} * {2 * math.pi!r}::DOUBLE)'), 'density')} FROM customer")
def sphere_distance_density(spark: SparkSession, d: str) -> DataFrame:
    g = F.expr(_SHARE) * (2 * math.pi)
    return rounded(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), geometry.Sphere(4, 2.0).density(g).alias("density")))


@query(f"WITH a AS (SELECT c_custkey AS id, {_SHARE} * {math.pi!r}::DOUBLE AS t, c_custkey % 97 / 30.0 AS x, c_custkey % 89 / 30.0 AS y FROM customer) SELECT id, {_r('3 * acos(least(1, greatest(-1, cos(x / 3) * cos(y / 3) + sin(x / 3) * sin(y / 3) * cos(t))))', 'g')} FROM a")
def sphere_cosine_law(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return rounded(read(spark, d, "customer").select(k.alias("id"), geometry.Sphere(2, 3.0).cosine_law(F.expr(_SHARE) * math.pi, k % 97 / 30.0, k % 89 / 30.0).alias("g")))


_NORMALS = ", ".join(
    f"sqrt(-2 * ln(1 - {UNIFORM.format(f"'11:' || id || ':{k}:a'")})) * cos({2 * math.pi!r}::DOUBLE * {UNIFORM.format(f"'11:' || id || ':{k}:b'")})" for k in range(3)
)


@query(f"WITH v AS (SELECT id, [{_NORMALS}] AS v FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)), n AS (SELECT id, v, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS n FROM v) SELECT CAST(id AS BIGINT) AS id, {_r('3 * v[1] / n', 'x0')}, {_r('3 * v[2] / n', 'x1')}, {_r('3 * v[3] / n', 'x2')} FROM n")
def sphere_points(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.Sphere(2, 3.0).sample_points(spark, read(spark, d, "customer").count(), seed=11)
    return rounded(p.select("id", *[F.col("x")[k].alias(f"x{k}") for k in range(3)]))


def _volumes_sql(k: int) -> str:
    one = f"{2 * math.pi ** ((k + 1) / 2) / math.gamma((k + 1) / 2)!r}::DOUBLE"
    return f"{_r(f'{one} * pow(r, {k})', f'volume_{k}')}, {_r(f'pow(v / {one}, {1 / k!r}::DOUBLE)', f'radius_{k}')}"


@query(f"WITH a AS (SELECT c_custkey AS id, 1 + {_SHARE} AS r, 100 * (1 + {_SHARE}) AS v FROM customer) SELECT id, {', '.join(_volumes_sql(k) for k in range(1, 5))} FROM a")
def sphere_volume(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of spheres of given radius and radii of spheres of given volume, in one to four dimensions."""
    r, v = 1 + F.expr(_SHARE), 100 * (1 + F.expr(_SHARE))
    each = [x for k in range(1, 5) for x in (E.sphere_volume(k, r).alias(f"volume_{k}"), E.sphere_radius(k, v).alias(f"radius_{k}"))]
    return rounded(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *each))


S, C = geometry.Layer("similarity"), geometry.Layer("complementarity")


def _layer_sql(kind: str, g: str, dim: int, r: float, mu: str = "0", beta: float = 1.5) -> str:
    e = g if kind == "similarity" else f"({math.pi * r!r}::DOUBLE - {g})"
    return f"(1 / (1 + exp({beta * dim!r}::DOUBLE * (ln(greatest({e}, 1e-9::DOUBLE)) - ({mu})) + {math.exp(-beta) * (beta + 1)!r}::DOUBLE * ({mu}))))"


def _union_sql(g: str, dim: int, r: float, mu: str = "0") -> str:
    return f"(1 - (1 - {_layer_sql('similarity', g, dim, r, mu)}) * (1 - {_layer_sql('complementarity', g, dim, r, mu)}))"


@query(f"WITH {_GS} SELECT i, j, {_r(_layer_sql('similarity', 'g', 63, 1.0), 'p')} FROM gs")
def geo_pair_probs(spark: SparkSession, d: str) -> DataFrame:
    m = geometry.GeometricModel.of(500, geometry.Sphere(63), S)
    return rounded(m.pair_probs(points(spark, d)).select("i", "j", "p"))


_MULTI = geometry.GeometricModel.of(500, geometry.Sphere(63), geometry.Layer("similarity", mu=0.4, beta=0.5), geometry.Layer("complementarity", mu=0.6, beta=0.5))


@query(f"WITH {_GS} SELECT i, j, {_r(f'1 - (1 - {_layer_sql("similarity", "g", 63, 1.0, "0.4", 0.5)}) * (1 - {_layer_sql("complementarity", "g", 63, 1.0, "0.6", 0.5)})', 'p')} FROM gs")
def geo_multilayer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_MULTI.pair_probs(points(spark, d)).select("i", "j", "p"))


@query(f"WITH {_GS} SELECT i AS src, j AS dst FROM gs WHERE {UNIFORM.format("'13:' || i || ':' || j")} < 1 - (1 - {_layer_sql('similarity', 'g', 63, 1.0, '0.4', 0.5)}) * (1 - {_layer_sql('complementarity', 'g', 63, 1.0, '0.6', 0.5)})")
def geo_sample(spark: SparkSession, d: str) -> DataFrame:
    return _MULTI.sample(points(spark, d), seed=13)


#: Each node's own mu in both layers and beta in one, from its label.
_OWN = "own AS (SELECT CAST(vec_id AS BIGINT) AS id, label / 40.0 + 0.1 AS m1, label / 50.0 + 0.2 AS m2, label / 30.0 + 0.2 AS b1 FROM embeddings)"
_LAYERS = geometry.GeometricModel.of(500, geometry.Sphere(63), geometry.Layer("similarity"), geometry.Layer("complementarity", beta=0.5))


@query(f"""WITH {_GS}, {_OWN}, e AS (SELECT i, j, a.m1 + b.m1 AS m1, a.m2 + b.m2 AS m2, a.b1 + b.b1 AS b1, ln(greatest(g, 1e-9::DOUBLE)) AS e1, ln(greatest({math.pi!r}::DOUBLE - g, 1e-9::DOUBLE)) AS e2
  FROM gs JOIN own a ON a.id = i JOIN own b ON b.id = j)
  SELECT i, j, {_r(f'1 - (1 - 1 / (1 + exp(b1 * 63 * (e1 - m1) + exp(-b1) * (b1 + 1) * m1))) * (1 - 1 / (1 + exp({0.5 * 63!r}::DOUBLE * (e2 - m2) + {math.exp(-0.5) * 1.5!r}::DOUBLE * m2)))', 'p')} FROM e""")
def geo_node_parameters(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    own = read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (label / 40.0 + 0.1).alias("m1"), (label / 50.0 + 0.2).alias("m2"), (label / 30.0 + 0.2).alias("b1"))
    return rounded(_LAYERS.pair_probs(own, parameters=[("m1", "b1"), ("m2", None)]).select("i", "j", "p"))


_UNIT = geometry.GeometricModel.of(500, geometry.Sphere(63), geometry.Layer("similarity", mu=0.4, beta=0.5))


@query(f"""WITH {_GS}, u AS (SELECT CAST(vec_id AS BIGINT) AS id, label + 1 AS w FROM embeddings), p AS (SELECT i, j, {_layer_sql('similarity', 'g', 63, 1.0, '0.4', 0.5)} AS p FROM gs),
  b AS (SELECT i, j, p FROM p UNION ALL SELECT j, i, p FROM p UNION ALL SELECT id, id, (w - 1.0) / w * {_layer_sql('similarity', '0', 63, 1.0, '0.4', 0.5)} FROM u)
  SELECT b.i AS id, {_r('sum(b.p * u.w)', 'degree')} FROM b JOIN u ON u.id = b.j GROUP BY b.i""")
def geo_unit_degree(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") + 1).alias("w"))
    return rounded(_UNIT.unit_degree(units))


_R2 = math.sqrt(100 / (4 * math.pi))
#: The quadrature table, made by its rule.
_QUAD = f"qd(g, w) AS (VALUES {', '.join(f'({g!r}::DOUBLE, {w!r}::DOUBLE)' for g, w in geometry.gauss_legendre(0.0, math.pi * _R2, 64))})"
#: mu of the layers, from suppliers.
_MU = "m AS (SELECT avg(s_acctbal) / 20000 AS mu FROM supplier)"
_MEAN = f"sum(w * {_density_sql(2, _R2, 'g')} * {_union_sql('g', 2, _R2, 'm.mu')})"
_TWO = geometry.GeometricModel.of(100, 2, S, C)


def _two_of(spark: SparkSession, d: str) -> geometry.GeometricModel:
    mu = mean_of(spark, d, "supplier", "s_acctbal") / 20000
    return _TWO.set_parameters({"mu": mu}, {"mu": mu})


@query(f"WITH {_QUAD}, {_MU} SELECT {_r(_MEAN, 'p')} FROM qd, m")
def geo_expected_probs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two_of(spark, d).expected_probability(spark, 64))


@query(f"WITH {_QUAD}, {N_NATION} SELECT a.id, {_r(f'sum(w * {_density_sql(2, _R2, "g")} * {_union_sql("g", 2, _R2, "a.mu + b.mu")})', 'degree')} FROM n a JOIN n b ON a.id <> b.id CROSS JOIN qd GROUP BY a.id")
def geo_expected_degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_TWO.expected_degree(spark, 64, nation(spark, d).all_nodes))


@query(f"""WITH {_QUAD}, {N_SUPPLIER}, u AS (SELECT round(mu, 1) AS code, avg(mu) AS mu, count(*) AS w FROM n GROUP BY 1),
  e AS (SELECT a.code, sum((b.w - CASE WHEN a.code = b.code THEN 1 ELSE 0 END) * qd.w * {_density_sql(2, _R2, "g")} * {_union_sql("g", 2, _R2, "a.mu + b.mu")}) AS degree FROM u a CROSS JOIN u b CROSS JOIN qd GROUP BY a.code)
  SELECT n.id, {_r('e.degree', 'degree')} FROM n JOIN e ON round(n.mu, 1) = e.code""")
def geo_quantized_degree(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_TWO.quantized_degree(spark, supplier(spark, d).all_nodes, 1, 64))


@query(f"WITH {_QUAD}, {_MU}, a AS (SELECT {_MEAN} AS a FROM qd, m) SELECT {_r('g', 'g')}, {_r(f'{_union_sql("g", 2, _R2, "m.mu")} * {_density_sql(2, _R2, "g")} / a', 'density')} FROM qd, m, a")
def geo_edge_distance_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two_of(spark, d).edge_distance_density(spark, 64))


_ANGLES = f"an(t, wt) AS (VALUES {', '.join(f'({g!r}::DOUBLE, {w!r}::DOUBLE)' for g, w in geometry.gauss_legendre(0.0, math.pi, 64))})"
_SIDE = f"({_R2!r}::DOUBLE * acos(least(1, greatest(-1, cos(a.g / {_R2!r}::DOUBLE) * cos(b.g / {_R2!r}::DOUBLE) + sin(a.g / {_R2!r}::DOUBLE) * sin(b.g / {_R2!r}::DOUBLE) * cos(t)))))"
_BOTH = f"(a.w * {_density_sql(2, _R2, 'a.g')} * {_layer_sql('similarity', 'a.g', 2, _R2, 'mu')} * b.w * {_density_sql(2, _R2, 'b.g')} * {_layer_sql('similarity', 'b.g', 2, _R2, 'mu')} * wt)"


@query(f"WITH {_QUAD}, {_ANGLES}, {_MU} SELECT {_r(f'sum({_BOTH} * {_layer_sql("similarity", "s", 2, _R2, "mu")}) / sum({_BOTH})', 'tclust')} FROM (SELECT *, {_SIDE} AS s FROM qd a CROSS JOIN qd b CROSS JOIN an CROSS JOIN m) x".replace("SELECT *, (", "SELECT a.g AS ag, a.w AS aw, b.g AS bg, b.w AS bw, t, wt, mu, (").replace(_BOTH, _BOTH.replace("a.g", "ag").replace("a.w", "aw").replace("b.g", "bg").replace("b.w", "bw")))
def geo_expected_tclust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two_of(spark, d).without(1).expected_tclust(spark, 64))


@query(f"WITH {N_CUSTOMER}, q AS (SELECT round(mu, 1) AS code, avg(mu) AS m, count(*) AS w FROM n GROUP BY 1) SELECT n.id, {_r('q.m', 'mu')}, q.w FROM n JOIN q ON round(n.mu, 1) = q.code")
def geo_quantize(spark: SparkSession, d: str) -> DataFrame:
    n = customer(spark, d).all_nodes
    q = geometry.quantize(n, 1)
    return rounded(geometry.dequantize(n, q.select("code", F.col("mu").alias("m"), F.col("w").alias("n_w")), 1).select("id", F.col("m").alias("mu"), F.col("n_w").alias("w")))


# Views, sources and checks

@query(f"WITH {N_SUPPLIER}, x AS (SELECT max(id) AS hi FROM n) SELECT CAST((hi - id) / 3 AS BIGINT) AS pos, id, {_r('mu', 'mu')} FROM n, x WHERE (hi - id) % 3 = 0 AND id > 4")
def nodes_slice_down(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).nodes[:4:-3].rows())


@query(f"WITH {N_SUPPLIER}, {P} SELECT i, j, {_r('p', 'p')} FROM p WHERE i >= 2 AND i < 7 AND j IN (1, 5)")
def pairs_slice_by_list(spark: SparkSession, d: str) -> DataFrame:
    return rounded(supplier(spark, d).pairs[2:7, [5, 1]].probs().select("i", "j", "p"))


@query(f"WITH {N_SUPPLIER} SELECT id FROM n WHERE id IN (1, 3, 5)")
def nodes_unique(spark: SparkSession, d: str) -> DataFrame:
    return supplier(spark, d).nodes[[5, 1, 3, 5]].unique()


@query("SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM (SELECT user_id % 40 AS u, CAST(event_id % 37 AS BIGINT) AS v FROM events) WHERE u <> v")
def edges_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical(read(spark, d, "events").select((F.col("user_id") % 40).cast("long").alias("src"), (F.col("event_id") % 37).cast("long").alias("dst")))


@query("WITH c AS (SELECT s_nationkey AS i, n_nationkey AS j, sum(s_acctbal) AS v FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 7 = 0 AND s_nationkey <> n_nationkey GROUP BY 1, 2) SELECT DISTINCT CAST(least(i, j) AS BIGINT) AS src, CAST(greatest(i, j) AS BIGINT) AS dst FROM c")
def edges_of_matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "supplier").select(F.col("s_nationkey").alias("i"), "s_suppkey").crossJoin(F.broadcast(read(spark, d, "nation").select(F.col("n_nationkey").alias("j"))))
    held = cells.groupBy("i", "j").agg(F.max(((F.col("s_suppkey") + F.col("j")) % 7 == 0).cast("int")).alias("v"))
    rows = held.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("values"))
    return from_matrix_rows(rows)


@query(f"WITH {GRAPH} SELECT {_r('(SELECT count(*) FROM g) / (SELECT count(*) FROM u)::DOUBLE', 'edge_count')}")
def obs_edge_count_normalized(spark: SparkSession, d: str) -> DataFrame:
    ids, edges = graph(spark, d)
    return rounded(observed.edge_count(edges, ids))


@query(f"SELECT s_suppkey AS id, s_acctbal BETWEEN 0 AND 5000 AS inside, {_r('s_acctbal', 'checked')} FROM supplier")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return rounded(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), Constraint(0.0, 5000.0).inside(x).alias("inside"), Constraint(-1e5, 1e5).check(x).alias("checked")))


@query(f"WITH {_GS} SELECT i, j, {_r('g', 'value')} FROM gs UNION ALL SELECT j, i, {_r('g', 'value')} FROM gs")
def pairwise_squareform(spark: SparkSession, d: str) -> DataFrame:
    g = geometry.distances(points(spark, d), geometry.Sphere(63))
    return rounded(iteration.squareform(g.withColumnRenamed("g", "value")))


# Scalar functions

@query(f"""WITH x AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier) SELECT id, {_r('ln(x + 1000)', 'lower')}, {_r('ln(10000.5 - x)', 'upper')}, {_r('ln((x + 1000) / (10000.5 - x))', 'both_')},
  {_r('(x + 1000) / 1000 + ln(1 - exp(-(x + 1000) / 1000))', 'soft')} FROM x""")
def constraint_transform(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal")
    return rounded(read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), E.constrain_free(x, lower=-1000.0).alias("lower"), E.constrain_free(x, upper=10000.5).alias("upper"), E.constrain_free(x, -1000.0, 10000.5).alias("both_"),
        E.constrain_free(x / 1000, lower=-1.0, soft=True).alias("soft"),
    ))


@query(f"""WITH x AS (SELECT s_suppkey AS id, s_acctbal / 5000 - 1 AS y FROM supplier) SELECT id, {_r('2 + exp(y)', 'lower')}, {_r('3 - exp(y)', 'upper')}, {_r('2 + 3 * exp(y) / (1 + exp(y))', 'both_')}, {_r('2 + ln(1 + exp(y))', 'soft')} FROM x""")
def constraint_inverse(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("s_acctbal") / 5000 - 1
    return rounded(read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), E.constrain_back(y, lower=2.0).alias("lower"), E.constrain_back(y, upper=3.0).alias("upper"), E.constrain_back(y, 2.0, 5.0).alias("both_"), E.constrain_back(y, lower=2.0, soft=True).alias("soft"),
    ))


@query(f"WITH {N_SUPPLIER}, {P}, x AS (SELECT i, min(p) AS a, max(p) AS b, avg(p) AS c FROM p GROUP BY i) SELECT i AS id, {_r('1 - (1 - a) * (1 - b) * (1 - c)', 'u')} FROM x")
def union_probability(spark: SparkSession, d: str) -> DataFrame:
    p = supplier(spark, d).pairs.probs().groupBy("i").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.avg("p").alias("c"))
    return rounded(p.select(F.col("i").alias("id"), E.union_probability(F.col("a"), F.col("b"), F.col("c")).alias("u")))


@query(f"WITH x AS (SELECT s_suppkey AS id, s_acctbal / 5000 + 0.5 AS x FROM supplier) SELECT id, {_r('CASE WHEN x > 0 THEN ln(exp(x) - 1) END', 'm')}, {_r('ln(1 + exp(x))', 'p')}, {_r('1 / (1 + exp(x))', 's')} FROM x")
def logexp1(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal") / 5000 + 0.5
    return rounded(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), E.logexpm1(x).alias("m"), E.log1pexp(x).alias("p"), E.decreasing_sigmoid(x).alias("s")))


# Parameter grids and error metrics

@query(f"""WITH g AS (SELECT CAST(n AS INT) AS n, CAST(k AS DOUBLE) AS k FROM (VALUES (100), (1000), (10000)) a(n), (VALUES (2.0), (4.0), (8.0), (16.0)) b(k)), e AS (SELECT user_id % 10 AS rep, avg(value) AS v FROM events GROUP BY 1)
  SELECT n, k, {_r('avg(k / (n - 1) * v)', 'mean')}, count(*) AS reps FROM g CROSS JOIN e GROUP BY n, k""")
def grid_group_mean(spark: SparkSession, d: str) -> DataFrame:
    reps = read(spark, d, "events").groupBy((F.col("user_id") % 10).alias("rep")).agg(F.avg("value").alias("v"))
    runs = grids.product(spark, n=[100, 1000, 10000], k=[2.0, 4.0, 8.0, 16.0]).select(F.col("n").cast("int").alias("n"), "k").crossJoin(F.broadcast(reps))
    return rounded(grids.group_mean(runs.withColumn("value", F.col("k") / (F.col("n") - 1) * F.col("v")), ["n", "k"], "value", "mean"))


@query(f"WITH {N_SUPPLIER}, {P}, {D}, e AS (SELECT d.i, d AS exact, n.mu AS other FROM d JOIN n ON n.id = d.i) SELECT {_r('sqrt(sum((exact - other) ** 2) / sum(exact ** 2))', 'error')}, {_r('corr(exact, other)', 'correlation')}, {_r('corr(exact, other) ** 2', 'r2')} FROM e")
def mc_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = supplier(spark, d)
    both = stats.degree(m.nodes).select("id", F.col("degree").alias("exact")).join(m.all_nodes.select("id", F.col("mu").alias("other")), "id")
    return rounded(grids.error_metrics(both, "exact", "other"))


# Kernels of the caller, pairwise functions, random numbers

_PP = iteration.pair_probability


@query(f"WITH {N_SUPPLIER}, {P}, {D}, {TW} SELECT i AS id, {_r('tw', 'value')} FROM tw")
def iterate_twedge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(iteration.iterate_product(supplier(spark, d).nodes, [_PP, _PP]))


@query(f"WITH {N_NATION}, {P}, x AS (SELECT a.i, sum(a.p * b.p) AS v FROM p a JOIN p b ON a.i = b.i GROUP BY a.i) SELECT i AS id, {_r('v', 'value')} FROM x")
def iterate_repeated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(iteration.iterate(nation(spark, d).nodes, 2, lambda i, j, k: _PP(i, j) * _PP(i, k), unique=False))



@query(f"""WITH {N_NATION}, {P}, a AS (SELECT i, j, p, sum(p) OVER (PARTITION BY i ORDER BY j) AS upto, sum(p) OVER (PARTITION BY i) AS total FROM p WHERE i <> j),
  x AS (SELECT a.*, r, total / p / 20 AS factor FROM a, range(20) t(r) WHERE {UNIFORM.format("'3:' || i || '::' || r")} >= (upto - p) / total AND {UNIFORM.format("'3:' || i || '::' || r")} < upto / total),
  b AS (SELECT x.i, x.j, x.r, x.p AS ij, x.factor, jk.j AS k, jk.p, sum(jk.p) OVER w AS upto, sum(jk.p) OVER (PARTITION BY x.i, x.r) AS total FROM x JOIN p jk ON jk.i = x.j AND jk.j <> x.i AND jk.j <> x.j WINDOW w AS (PARTITION BY x.i, x.r ORDER BY jk.j)),
  y AS (SELECT b.*, total / p / 20 AS other FROM b, range(20) t(s) WHERE {UNIFORM.format("'3:' || i || ':/' || r || ':' || s")} >= (upto - p) / total AND {UNIFORM.format("'3:' || i || ':/' || r || ':' || s")} < upto / total)
  SELECT y.i AS id, {_r('sum(y.factor * y.other * y.ij * y.p * ik.p / 2)', 'value')} FROM y JOIN p ik ON ik.i = y.i AND ik.j = y.k GROUP BY y.i""")
def mc_iterate_triangle(spark: SparkSession, d: str) -> DataFrame:
    kernel = lambda i, j, k: _PP(i, j) * _PP(j, k) * _PP(i, k) / 2
    return rounded(iteration.iterate_sampled(nation(spark, d).nodes, 2, kernel, [_PP, lambda i, j, k: _PP(j, k)], 20, seed=3))


@query(f"WITH {_POINTS} SELECT a.id AS i, b.id AS j, {_r('list_sum(list_transform(list_zip(a.x, b.x), lambda v: abs(v[1] - v[2])))', 'value')} FROM pts a JOIN pts b ON a.id < b.id")
def pairwise_manhattan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(iteration.pairwise_blocks(points(spark, d), iteration.manhattan))


@query("SELECT CAST(user_id AS BIGINT) AS id, array_to_string(list(event_type ORDER BY event_id), ',') AS types FROM events GROUP BY user_id")
def split_by(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").cast("long").alias("id"), "event_id", "event_type")
    return iteration.split_by(e, "id", "event_id", "event_type").select("id", F.array_join("values", ",").alias("types"))


@query("WITH b AS (SELECT n, unnest(range(0, n, 7)) AS start FROM (SELECT count(*) AS n FROM customer)) SELECT start, least(start + 7, n) AS stop FROM b")
def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(iteration.batch_slices(F.col("n"), 7)).alias("b")).select("b.start", "b.stop")


def _u(parts: str) -> str:
    return UNIFORM.format(parts)


@query(f"""SELECT CAST(id AS BIGINT) AS id, {_r(f"2 + 3 * {_u("'5:' || id")}", 'uniform')}, {_r(f"1 + 2 * sqrt(-2 * ln(1 - {_u("'5:' || id || ':r'")})) * cos({2 * math.pi!r}::DOUBLE * {_u("'5:' || id || ':t'")})", 'normal')},
  {_r(f"-ln(1 - {_u("'5:' || id")}) / 2", 'exponential')}, CAST(floor({_u("'5:' || id")} * 10) AS BIGINT) AS choice, {_u("'5:' || id")} < 0.3 AS bernoulli FROM (SELECT c_custkey AS id FROM customer)""")
def random_numbers(spark: SparkSession, d: str) -> DataFrame:
    g, i = RandomGenerator(5), F.col("id")
    return rounded(read(spark, d, "customer").select(F.col("c_custkey").alias("id")).select("id", g.uniform(i, low=2.0, high=5.0).alias("uniform"), g.normal(i, mean=1.0, sd=2.0).alias("normal"), g.exponential(i, rate=2.0).alias("exponential"), g.choice(10, i).alias("choice"), g.bernoulli(0.3, i).alias("bernoulli")))


from . import parts, scaled  # noqa: E402, F401  # they add their own queries to the same tables
