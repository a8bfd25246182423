"""Maximum-likelihood fits of mu to observed graphs.

A homogeneous fit is closed: mu = logit of the observed density.  With one mu for
each node, nodes of equal degree have equal mu at the optimum, so the unknowns are the
distinct degrees, at most about the square root of twice the edges; their
equations E[degree] = degree are solved on the driver by Newton steps up to NEWTON_CLASSES of them, and beyond
by L-BFGS steps on the negative log-likelihood, whose value and gradient are a distributed sum over pairs of classes; the driver has a few vectors of a number
for each class.  A start may be
given by name or as a table; it decides where the steps begin.  A solution tells its steps, its error and whether it
converged, and fit() raises where it did not.  Nodes
of degree 0 have mu = -infinity, written as null, and stay out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..plans.model import Ensemble, spread
from ..sources.checkpoints import cut
from . import observed, stats

#: Distinct degrees up to which Newton steps solve a dense system; a fixed point goes on from there.
NEWTON_CLASSES = 3000
INITS = {"homogeneous": "er", "erdos_renyi": "er", "er": "er", "erdos": "er", "heterogeneous": "cm", "chung-lu": "cm", "configuration-model": "cm", "cm": "cm", "random": "random", "zeros": "zeros"}


def homogeneous_mu(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (mu): ln(p / (1 - p)) of the observed density p, infinite for an empty or complete graph."""
    p = F.col("density")
    mu = F.when(p <= 0, -F.lit(E.INF)).when(p >= 1, F.lit(E.INF)).otherwise(F.ln(p / (1 - p)))
    return observed.density(ids, edges).select(mu.alias("mu"))


def initial(ids: DataFrame, edges: DataFrame, how: str = "cm", seed: int = 0) -> DataFrame:
    """(id, mu): start values by name; null for isolated nodes where the formula gives -infinity."""
    kind = INITS[how]
    if kind == "er":
        return ids.select("id").crossJoin(F.broadcast(homogeneous_mu(ids, edges)))
    if kind == "cm":
        k = cut(observed.degree(ids, edges))
        total = F.broadcast(k.agg(F.sqrt(F.sum("degree").cast("double")).alias("root")))
        return k.crossJoin(total).select("id", F.when(F.col("degree") > 0, F.ln(F.col("degree") / F.col("root"))).alias("mu"))
    if kind == "random":
        return ids.select("id", (1 - 2 * E.hash_uniform(seed, F.col("id"))).alias("mu"))
    return ids.select("id", F.lit(0.0).alias("mu"))


@dataclass(frozen=True)
class Solution:
    """mu by distinct degree, and how it was reached."""

    mu: dict[int, float]
    iterations: int
    error: float
    converged: bool


def _dense(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Expected degrees of classes with weights w, by mu."""

    def expected(mu: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(mu[:, None] + mu[None], -700, 700)))
        return p @ w - np.diag(p)

    return expected


#: Most that a step changes a mu: where probabilities are all but 0 or 1 there is no slope to come back by.
LONGEST = 2.0
#: The value of a sum over pairs and its derivatives: the sum over i < j of ln(1 + exp(mu_i + mu_j)), and each class's expected degree.
Sums = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _distributed(spark: SparkSession, w: np.ndarray) -> Sums:
    """As sums over pairs of classes in the cluster; two numbers for each class come back."""

    def sums(mu: np.ndarray) -> tuple[float, np.ndarray]:
        classes = spark.createDataFrame(list(zip(range(len(mu)), mu.tolist(), w.tolist(), strict=True)), "c long, mu double, w double")
        x = F.col("mu") + F.col("mu_j")
        other = classes.select(F.col("mu").alias("mu_j"), "w")
        found = spread(classes.select("c", "mu")).crossJoin(spread(other)).groupBy("c", "mu").agg(F.sum(F.col("w") * E.probability(-x)).alias("e"), F.sum(F.col("w") * E.log1pexp(x)).alias("f"))
        got = found.select("c", (F.col("e") - E.probability(-2 * F.col("mu"))).alias("e"), (F.col("f") - E.log1pexp(2 * F.col("mu"))).alias("f")).orderBy("c").toPandas()
        return float(w @ got["f"].to_numpy()) / 2, got["e"].to_numpy()

    return sums


def minimized(sums: Sums, k: np.ndarray, w: np.ndarray, mu: np.ndarray, tolerance: float, most: int, memory: int = 12) -> tuple[np.ndarray, int, float]:
    """(mu, steps, error) by L-BFGS of sums less w k mu, whose gradient is w (e - k); error: the largest of |e - k|.

    Variables are scaled by about the square root of their second derivatives, so the first steps are of the right size.
    """
    n = w.sum()
    scale = np.sqrt(w * np.maximum(k * (1 - k / n), 1e-3))

    def at(y: np.ndarray) -> tuple[float, np.ndarray, float]:
        f, e = sums(y / scale)
        return f - float(w @ (k * y / scale)), w * (e - k) / scale, float(np.abs(e - k).max())

    y = mu * scale
    value, gradient, error = at(y)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while step < most and error > tolerance:
        step += 1
        q, used = gradient.copy(), []
        for s, t in reversed(pairs):
            a = (s @ q) / (s @ t)
            q -= a * t
            used.append(a)
        if pairs:
            s, t = pairs[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - (t @ q) / (s @ t))
        slope, length = -float(q @ gradient), 1.0
        if slope >= 0:
            q, slope, length, pairs = gradient.copy(), -float(gradient @ gradient), 1.0, []
        length = min(length, LONGEST / float(np.abs(q / scale).max()))
        while True:
            new = y - length * q
            found = at(new)
            # near the minimum values agree to rounding, and the gradient decides
            close = abs(found[0] - value) <= 1e-11 * abs(value) and np.abs(found[1]).max() < np.abs(gradient).max()
            if close or found[0] <= value + 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-6:
                return y / scale, step, error
        if (new - y) @ (found[1] - gradient) > 0:
            pairs = [*pairs, (new - y, found[1] - gradient)][-memory:]
        y, (value, gradient, error) = new, found
    return y / scale, step, error


def solve_classes(degrees: np.ndarray, counts: np.ndarray, rtol: float = 1e-9, most: int = 128, start: np.ndarray | None = None, spark: SparkSession | None = None, newton_classes: int = NEWTON_CLASSES) -> Solution:
    """mu for each positive degree such that expected degrees are the observed ones; counts: nodes of each degree; start: mu of each."""
    keep = degrees > 0
    k, w = degrees[keep].astype(float), counts[keep].astype(float)
    if not len(k):
        return Solution({}, 0, 0.0, True)
    n = w.sum()
    mu = np.log(k / math.sqrt((k * w).sum()))
    if start is not None:
        mu = np.where(np.isfinite(start[keep]), start[keep], mu)
    if len(k) > newton_classes:
        if spark is None:
            raise ValueError(f"{len(k)} classes are solved with a session only")
        # a node that is joined with all others has no finite mu, so it only comes as near as the tolerance asks
        mu, step, error = minimized(_distributed(spark, w), k, w, mu, max(rtol, 1e-7) * max(1.0, float(k.max())), most)
        return Solution(dict(zip(degrees[keep].tolist(), mu.tolist(), strict=True)), step, error, error <= 1e-5 * max(1.0, float(k.max())))
    expected = _dense(w)

    error, step = np.inf, 0
    for step in range(1, most + 1):
        e = expected(mu)
        error = float(np.abs(e - k).max())
        if error <= rtol * max(1.0, float(k.max())):
            break
        if (k < n - 1).all():
            p = 1 / (1 + np.exp(-np.clip(mu[:, None] + mu[None], -700, 700)))
            v = p * (1 - p)
            jac = v * w[None]
            jac[np.diag_indices(len(k))] += v @ w - 2 * np.diag(v)
            try:
                delta = np.linalg.solve(jac, e - k)
            except np.linalg.LinAlgError:
                delta = np.log(e / k)
            scale = 1.0
            while scale > 1e-4 and np.abs(expected(mu - scale * delta) - k).max() > error:
                scale /= 2
            mu = mu - scale * delta if scale > 1e-4 else mu - np.log(e / k)
        else:
            mu = mu - np.log(e / k)
    return Solution(dict(zip(degrees[keep].tolist(), mu.tolist(), strict=True)), step, error, error <= 1e-5 * max(1.0, float(k.max())))


def checked_targets(ids: DataFrame, degrees: DataFrame) -> DataFrame:
    """degrees(id, degree) of exactly the nodes ids, or an error: targets must be numbers from 0 to n - 1, one for each node."""
    n = ids.count()
    found, distinct, known, bad = degrees.join(ids.select("id", F.lit(True).alias("known")), "id", "left").agg(
        F.count(F.lit(1)), F.count_distinct("id"), F.count("known"), F.count_if(F.col("degree").isNull() | (F.col("degree") < 0) | (F.col("degree") > n - 1))
    ).first()
    if not found == distinct == known == n or bad:
        raise ValueError(f"targets must be a degree from 0 to {n - 1} for each of {n} nodes: {found} rows, {known} of nodes, {bad} out of range")
    return degrees


def fit_degrees(ids: DataFrame, edges: DataFrame, start: DataFrame | str | None = None, newton_classes: int = NEWTON_CLASSES) -> tuple[DataFrame, Solution]:
    """(id, degree, mu), and the solution; mu is null for isolated nodes.  start: a name of initial(), or (id, mu)."""
    k = cut(observed.degree(ids, edges))
    if isinstance(start, str):
        start = initial(ids, edges, start)
    rows = k if start is None else k.join(start.select("id", "mu"), "id", "left")
    classes = rows.groupBy("degree").agg(F.count(F.lit(1)).alias("count"), (F.lit(None).cast("double") if start is None else F.avg("mu")).alias("mu")).orderBy("degree").toPandas()
    spark = ids.sparkSession
    found = solve_classes(classes["degree"].to_numpy(), classes["count"].to_numpy(), start=classes["mu"].to_numpy(dtype=float), spark=spark, newton_classes=newton_classes)
    table = spark.createDataFrame(list(found.mu.items()), "degree long, mu double")
    return k.join(table, "degree", "left").select("id", "degree", "mu"), found


def fit(ids: DataFrame, edges: DataFrame, how: str = "heterogeneous", method: str = "lagrangian", start: DataFrame | str | None = None) -> DataFrame:
    """(id, mu) of the fitted model; an error if the steps do not converge."""
    if method != "lagrangian":
        raise NotImplementedError(f"no objective for method {method!r}")
    if INITS[how] == "er":
        return initial(ids, edges, "er")
    fitted, solution = fit_degrees(ids, edges, start)
    if not solution.converged:
        raise RuntimeError(f"no convergence in {solution.iterations} steps: expected degrees are off by {solution.error:.3g}")
    return fitted.select("id", "mu")


def expectations(params: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, degree): expected degrees under params(id, mu); a node without mu has none."""
    known = params.where("mu is not null").select("id", "mu")
    degree = stats.degree(Ensemble.heterogeneous(known).nodes).select("id", "degree")
    return ids.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def hamiltonian(params: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sum of theta_i k_i = -sum of mu_i k_i; isolated nodes count as 0."""
    k = observed.degree(ids, edges)
    return k.join(params.select("id", "mu"), "id").where("degree > 0").agg(F.coalesce(-F.sum(F.col("mu") * F.col("degree")), F.lit(0.0)).alias("hamiltonian"))


def lagrangian(params: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: hamiltonian less free energy, the negative log-likelihood."""
    model = Ensemble.heterogeneous(params.where("mu is not null"))
    f = stats.free_energy(model)
    return hamiltonian(params, ids, edges).crossJoin(F.broadcast(f)).select((F.col("hamiltonian") - F.col("free_energy")).alias("lagrangian"))


def log_likelihood(params: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sum of ln p over edges and of ln(1 - p) over the other pairs, as ln p - ln(1 - p) = mu_i + mu_j on edges."""
    known = params.where("mu is not null")
    f = stats.free_energy(Ensemble.heterogeneous(known))
    a, b = known.select(F.col("id").alias("src"), F.col("mu").alias("mu_i")), known.select(F.col("id").alias("dst"), F.col("mu").alias("mu_j"))
    on_edges = edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.col("mu_i") + F.col("mu_j")), F.lit(0.0)).alias("e"))
    return on_edges.crossJoin(F.broadcast(f)).select((F.col("e") + F.col("free_energy")).alias("log_likelihood"))
