"""Column expressions of the pair model: couplings, probabilities, stable logarithms, hash-uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def coupling(mu_sum: Column, i: Column | None = None, j: Column | None = None) -> Column:
    """theta_i + theta_j = -(mu_i + mu_j); infinite on the diagonal."""
    c = -mu_sum
    return c if i is None else F.when(i == j, F.lit(INF)).otherwise(c)


def probability(c: Column) -> Column:
    """1 / (1 + exp(coupling)); exp overflows to infinity, which gives 0."""
    return 1 / (1 + F.exp(c))


def log1pexp(x: Column) -> Column:
    """ln(1 + exp(x)), stable for either sign."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logexpm1(x: Column) -> Column:
    """ln(exp(x) - 1) for x > 0; null elsewhere."""
    return F.when(x > 0, x + F.log1p(-F.exp(-x)))


def log_probability(c: Column) -> Column:
    """ln of probability(c)."""
    return -log1pexp(c)


def edge_free_energy(c: Column) -> Column:
    """ln of 1 - probability(c); 0 for an infinite coupling."""
    return F.when(c == F.lit(INF), F.lit(0.0)).otherwise(-log1pexp(-c))


def decreasing_sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(x))


def union_probability(*p: Column) -> Column:
    """Probability that any of independent events happens."""
    none = F.lit(1.0)
    for x in p:
        none = none * (1 - x)
    return 1 - none


def clip01(x: Column) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b within [0, 1]; null where b is 0."""
    return clip01(F.try_divide(a, b))


def hash_uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) of 52 bits that only depends on the parts' values: stable under any partitioning."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


# Spheres


def sphere_volume(dim: int, r: float | Column = 1.0) -> float | Column:
    """Surface measure of the dim-sphere of radius r."""
    return 2 * math.pi ** ((dim + 1) / 2) / math.gamma((dim + 1) / 2) * r**dim


def sphere_radius(dim: int, volume: float | Column) -> float | Column:
    """The radius that gives the volume."""
    return (volume / sphere_volume(dim)) ** (1 / dim)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sphere_distance(x: Column, y: Column, r: float = 1.0) -> Column:
    """Geodesic distance of points with |x| = r; points of different dimensions raise."""
    same = F.when(F.size(x) == F.size(y), dot(x, y)).otherwise(F.raise_error(F.lit("points of different dimensions")).cast("double"))
    return r * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), same / (r * r))))


def sphere_distance_density(g: Column, dim: int, r: float = 1.0) -> Column:
    """Density of the distance of two uniform points."""
    c = math.gamma((dim + 1) / 2) / (math.sqrt(math.pi) * math.gamma(dim / 2) * r)
    return F.greatest(c * F.pow(F.greatest(F.sin(g / r), F.lit(0.0)), F.lit(float(dim - 1))), F.lit(0.0)) if dim > 1 else F.lit(c)


def sphere_cosine_law(theta: Column, g_ij: Column, g_ik: Column, r: float = 1.0) -> Column:
    """The distance of j and k from their distances to i and the angle between them."""
    a, b = g_ij / r, g_ik / r
    return r * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.cos(a) * F.cos(b) + F.sin(a) * F.sin(b) * F.cos(theta))))


# Transforms of constrained variables to the real line


def constrain_free(x: Column, lower: float | None = None, upper: float | None = None, soft: bool = False) -> Column:
    """The real number that stands for a value within bounds; soft: by ln(exp(x) - 1) rather than ln(x)."""
    f = logexpm1 if soft else (lambda v: F.when(v > 0, F.ln(v)))
    if lower is None and upper is None:
        return x
    if upper is None:
        return f(x - lower)
    if lower is None:
        return f(upper - x)
    return f(F.try_divide(x - lower, upper - x))


def constrain_back(y: Column, lower: float | None = None, upper: float | None = None, soft: bool = False) -> Column:
    """The inverse of constrain_free."""
    if lower is None and upper is None:
        return y
    s = log1pexp(y) if soft else F.exp(y)
    if upper is None:
        return lower + s
    if lower is None:
        return upper - s
    return lower + (upper - lower) * s / (1 + s)


def checked_bounds(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """x, or an error if it is out of bounds."""
    bad = F.lit(False)
    if lower is not None:
        bad = bad | (x < lower)
    if upper is not None:
        bad = bad | (x > upper)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"value out of bounds [{lower}, {upper}]")).cast("double")).otherwise(x)
