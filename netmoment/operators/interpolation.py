"""Sums over all nodes as functions of one node's mu, interpolated with a bound on the error.

For continuous parameters nearly every node is a class of its own, and sums over classes are n**2 terms.  But S(mu), the sum over j of f(mu + mu_j) with
f a sigmoid or ln(1 - p), is smooth: it is summed exactly at a few Chebyshev points of each of some pieces of the line, a term for each
point and class, and evaluated for each node from the piece's coefficients, a few multiplications a node.

The bound: f is analytic where the imaginary part stays below pi.  On the ellipse around a piece of half width h that reaches pi/2 (semi-axes
h (r + 1/r) / 2 along and h (r - 1/r) / 2 = pi / 2 across), the real part of exp(z) is not negative, so |1 + exp(z)| >= 1: a sigmoid and its square are at most 1 there, and ln(1 + exp(z)) at most
max(0, x) + ln 2 + pi / 2.  Interpolation in m + 1 Chebyshev points is then off by at most 4 M r**-m / (r - 1) for each node summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..plans.model import Ensemble, spread

#: Half the width of a piece, and most pieces; wider ranges get wider pieces and more points.
HALF = 0.5
MOST_PIECES = 256
MOST_DEGREE = 128

#: Functions of x = mu_i + mu_j that are summed: the column, and a bound on the ellipse for real parts up to x.
TERMS: dict[str, tuple[Callable[[Column], Column], Callable[[float], float]]] = {
    "p": (lambda x: E.probability(-x), lambda x: 1.0),
    "p2": (lambda x: E.probability(-x) * E.probability(-x), lambda x: 1.0),
    "free": (lambda x: E.edge_free_energy(-x), lambda x: max(0.0, x) + math.log(2) + math.pi / 2),
}


@dataclass(frozen=True)
class Pieces:
    """Pieces of the range of mu: the first one's lower end, half widths, how many, the degree on each, and the bound on the error of a sum."""

    low: float
    half: float
    count: int
    degree: int
    bound: float

    def at(self, mu: Column) -> Column:
        """The piece of mu."""
        return F.least(F.greatest(F.floor((mu - self.low) / (2 * self.half)), F.lit(0)), F.lit(self.count - 1)).cast("int")

    def inside(self, mu: Column, piece: Column) -> Column:
        """mu's place in its piece, from -1 to 1."""
        return (mu - self.low - (2 * piece + 1) * self.half) / self.half


def error_bound(half: float, degree: int, most: float, n: int) -> float:
    """Of a sum of n terms, each at most `most` on the ellipse, from degree + 1 points on a piece of half width half."""
    a = math.pi / half  # r - 1 / r
    r = (a + math.sqrt(a * a + 4)) / 2
    return 4 * most * r**-degree / (r - 1) * n


def pieces_of(low: float, high: float, n: int, most: float, tolerance: float, slope: float = 1.0) -> Pieces:
    """Pieces and points from low to high with which a sum of n terms is off by tolerance at most (besides rounding); an error if that takes more than MOST_DEGREE.

    A term is a function of slope * mu that is most at most on the ellipse.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    count = max(1, min(MOST_PIECES, math.ceil((high - low) * slope / (2 * HALF))))
    half = max((high - low) / (2 * count), 1e-9)
    for degree in range(4, MOST_DEGREE + 1, 2):
        if (bound := error_bound(half * slope, degree, most, n)) <= tolerance:
            return Pieces(low, half, count, degree, bound)
    raise ValueError(f"no {MOST_DEGREE} points a piece give errors below {tolerance:g}: the range of mu is {high - low:g}")


def plan(model: Ensemble, names: tuple[str, ...], tolerance: float) -> Pieces:
    """pieces_of() for sums of TERMS over a model's nodes."""
    low, high = model.all_nodes.agg(F.min("mu"), F.max("mu")).first()
    # the ellipse reaches sqrt(half**2 + (pi / 2)**2) - half beyond its piece, less than pi / 2
    most = max(TERMS[n][1](2 * high + math.pi / 2) for n in names)
    return pieces_of(low, high, model.n, most, tolerance)


def coefficients(others: DataFrame, pieces: Pieces, sums: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(piece, names): arrays of Chebyshev coefficients of the sums over others(mu_j, w, …) of w * f(x), x = mu + mu_j; f may use others' columns."""
    m = pieces.degree
    grid = others.sparkSession.range(pieces.count * (m + 1)).select(F.floor(F.col("id") / (m + 1)).cast("int").alias("piece"), (F.col("id") % (m + 1)).cast("int").alias("k"))
    angle = (F.col("k") + 0.5) * (math.pi / (m + 1))
    grid = grid.withColumn("mu", F.lit(pieces.low) + (2 * F.col("piece") + 1) * pieces.half + pieces.half * F.cos(angle))
    x = F.col("mu") + F.col("mu_j")
    at = spread(grid).crossJoin(spread(others)).groupBy("piece", "k").agg(*[F.sum(F.col("w") * f(x)).alias(n) for n, f in sums.items()])
    listed = at.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("k", *sums))).alias("v"))  # degree + 1 values

    def coefficient(name: str) -> Column:
        def one(q: Column) -> Column:
            total = F.aggregate(F.col("v"), F.lit(0.0), lambda s, v: s + v[name] * F.cos(q * (v["k"] + 0.5) * (math.pi / (m + 1))))
            return total * F.when(q == 0, 1.0).otherwise(2.0) / (m + 1)

        return F.transform(F.sequence(F.lit(0), F.lit(m)), one)

    return listed.select("piece", *[coefficient(n).alias(n) for n in sums])


def clenshaw(c: Column, x: Column) -> Column:
    """The series with coefficients c at x."""
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("d"))
    return F.aggregate(F.reverse(c), start, lambda s, v: F.struct((v + 2 * x * s["b"] - s["d"]).alias("b"), s["b"].alias("d")), lambda s: s["b"] - x * s["d"])


def evaluated(rows: DataFrame, pieces: Pieces, table: DataFrame, names: list[str]) -> DataFrame:
    """rows(…, mu) with the interpolated names; the table has at most MOST_PIECES * MOST_DEGREE numbers for each."""
    named = table.select("piece", *[F.col(n).alias(f"{n}_c") for n in names])
    placed = rows.withColumn("piece", pieces.at(F.col("mu"))).join(F.broadcast(named), "piece")
    x = pieces.inside(F.col("mu"), F.col("piece"))
    return placed.withColumns({n: clenshaw(F.col(f"{n}_c"), x) for n in names}).drop("piece", *[f"{n}_c" for n in names])


def _others(model: Ensemble) -> DataFrame:
    return model.classes().select(F.col("mu").alias("mu_j"), "w")


def node_sums(model: Ensemble, focal: DataFrame, tolerance: float, first_only: bool = False) -> tuple[DataFrame, float]:
    """(id, mu, d, s[, m]) of focal(id, mu) as stats.node_sums, and the bound on the error of d and s; m's is at most n times that and its own."""
    pieces = plan(model, ("p", "p2"), tolerance)
    table = coefficients(_others(model), pieces, {n: TERMS[n][0] for n in ("p", "p2")})
    own = E.probability(-2 * F.col("mu"))

    def sums(of: DataFrame) -> DataFrame:
        return evaluated(of, pieces, table, ["p", "p2"]).withColumns({"d": F.col("p") - own, "s": F.col("p2") - own * own}).drop("p", "p2")

    found = sums(focal)
    if first_only:
        return found.select("id", "mu", "d", "s"), pieces.bound
    others = sums(model.classes()).select(F.col("mu").alias("mu_j"), (F.col("w") * F.col("d")).alias("w"))
    heads = coefficients(others, pieces, {"m": TERMS["p"][0]})
    return evaluated(found, pieces, heads, ["m"]).withColumn("m", F.col("m") - own * F.col("d")).select("id", "mu", "d", "s", "m"), pieces.bound


def node_free_energy(model: Ensemble, focal: DataFrame, tolerance: float) -> tuple[DataFrame, float]:
    """(id, mu, free_energy) of focal(id, mu), half the sum of ln(1 - p), and the bound on its error."""
    pieces = plan(model, ("free",), 2 * tolerance)
    table = coefficients(_others(model), pieces, {"free": TERMS["free"][0]})
    found = evaluated(focal, pieces, table, ["free"])
    return found.select("id", "mu", ((F.col("free") - E.edge_free_energy(-2 * F.col("mu"))) / 2).alias("free_energy")), pieces.bound / 2


#: Points that may stand for all nodes, at most.
MOST_POINTS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def grid(model: Ensemble, tolerance: float) -> Pieces:
    """Pieces for products of sigmoids of sums of mu, of twice one mu too; an error if they have more than MOST_POINTS points."""
    low, high = model.all_nodes.agg(F.min("mu"), F.max("mu")).first()
    pieces = pieces_of(low, high, model.n, 1.0, tolerance, 2.0)
    if pieces.count * (pieces.degree + 1) > MOST_POINTS:
        raise ValueError(f"the range of mu takes more than {MOST_POINTS} points")
    return pieces


def measure(model: Ensemble, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(x, w): the pieces' Chebyshev points, and weights with which a sum over them is that of the interpolated function over all nodes."""
    m = pieces.degree
    inside = F.least(F.greatest(pieces.inside(F.col("mu"), F.col("piece")), F.lit(-1.0)), F.lit(1.0))
    placed = model.classes().withColumn("piece", pieces.at(F.col("mu"))).withColumn("turn", F.acos(inside))
    each = placed.select("piece", "w", "turn", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("q"))
    moments = np.zeros((pieces.count, m + 1))
    for r in each.groupBy("piece", "q").agg(F.sum(F.col("w") * F.cos(F.col("q") * F.col("turn"))).alias("t")).collect():  # a number for each point
        moments[r.piece, r.q] = r.t
    angle = (np.arange(m + 1) + 0.5) * (math.pi / (m + 1))
    basis = np.cos(np.outer(np.arange(m + 1), angle)) * np.where(np.arange(m + 1) == 0, 1.0, 2.0)[:, None] / (m + 1)
    x = pieces.low + (2 * np.arange(pieces.count)[:, None] + 1) * pieces.half + pieces.half * np.cos(angle)
    return x.ravel(), (moments @ basis).ravel()


def _squares(a: float, x: np.ndarray, w: np.ndarray, P: np.ndarray, twice: np.ndarray) -> float:
    """Chordless squares at a node of mu a, from points x that stand for all nodes with weights w; P: their probabilities, twice: of each with itself."""
    # opposite nodes k: all but the focal one, which goes as a term of its own
    y, weight = np.append(x, a), np.append(w, -1.0)
    p, own = _sigmoid(a + x), _sigmoid(2 * a)
    yx = np.vstack([P, p])
    ay, yy = np.append(p, own), np.append(twice, own)
    both = yx * p  # of j with the focal and the opposite node
    weighed, open_ = both * w, 1 - yx
    at_i, at_k = own * ay, ay * yy
    pairs = ((weighed @ (1 - P)) * weighed).sum(1) - 2 * at_i * (weighed @ (1 - p)) - 2 * at_k * (weighed * open_).sum(1)
    pairs += at_i**2 * (1 - own) + at_k**2 * (1 - yy) + 2 * at_i * at_k * (1 - ay)
    # less j and l at one node
    pairs -= (both * weighed) @ (1 - twice) - at_i**2 * (1 - own) - at_k**2 * (1 - yy)
    return float((weight * (1 - ay)) @ pairs) / 2


def motifs(model: Ensemble, focal: DataFrame, names: list[str], pieces: Pieces) -> DataFrame:
    """(mu, names) of the distinct mu of focal, names among triangle, quadrangle, qwedge and qhead, with the points of grid() in place of all nodes: work in proportion to the nodes.

    Sums over nodes are interpolated one after the other, terms of coinciding nodes are taken off as functions of mu; weights of a piece add up to log(degree) + 2 times its nodes at most, so the
    error is below (log(degree) + 3) n times the pieces' bound for a triangle, and the square of that factor for a square.
    """
    x, w = measure(model, pieces)
    P, twice = _sigmoid(x[:, None] + x), _sigmoid(2 * x)
    inner = P * w[:, None] * w
    d, s = P @ w - twice, (P * P) @ w - twice**2
    m = P @ (w * d) - twice * d

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            mu = part["mu"].to_numpy()
            p, own = _sigmoid(mu[:, None] + x), _sigmoid(2 * mu)
            # less j or k at the focal node, and both at one
            t = (((p @ inner) * p).sum(1) - 2 * own * ((p * p) @ w) - (p * p) @ (w * twice) + 2 * own**3) / 2
            d_i, s_i = p @ w - own, (p * p) @ w - own**2
            m_i = p @ (w * d) - own * d_i
            head = lambda q, s_j, m_j, d_k: q * (m_j - q * d_k - s_j + q * q)
            values = {
                "triangle": lambda: t,
                "qwedge": lambda: (p * (d_i[:, None] - p) * (d - p)) @ w - own * (d_i - own) ** 2 - 2 * t,
                "qhead": lambda: head(p, s, m, d_i[:, None]) @ w - head(own, s_i, m_i, d_i) - 2 * t,
                "quadrangle": lambda: [_squares(v, x, w, P, twice) for v in mu.tolist()],
            }
            yield pd.DataFrame({"mu": mu} | {n: values[n]() for n in names})

    return spread(focal.select("mu").distinct()).mapInPandas(run, ", ".join(["mu double", *[f"{n} double" for n in names]]))
