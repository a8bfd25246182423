"""Expected statistics of nodes and of whole graphs.

Sums over all nodes are sums over classes, the distinct values of mu with their
multiplicities, less the node's own term; with repeated parameters this is exact
and needs (distinct values)**2 terms instead of n**2.  Selections restrict the
focal side before the join; the other side is always whole.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..plans import options
from ..plans.model import Ensemble, NodeView, spread
from . import classes, interpolation, kernels

TRIANGLE = ("triangle", "twedge", "thead")
QUADRANGLE = ("quadrangle", "qwedge", "qhead")
#: name: (numerator, factor, denominators)
COEFFICIENTS = {
    "tclust": ("triangle", 2, ("twedge",)),
    "tclosure": ("triangle", 2, ("thead",)),
    "similarity": ("triangle", 4, ("twedge", "thead")),
    "qclust": ("quadrangle", 2, ("qwedge",)),
    "qclosure": ("quadrangle", 2, ("qhead",)),
    "complementarity": ("quadrangle", 4, ("qwedge", "qhead")),
}


#: Classes above which sums are interpolated (see interpolation), and how far off those of one node are then at most.
MANY_CLASSES, TOLERANCE = 4096, 1e-12


def _many(model: Ensemble, names: tuple[str, ...], tolerance: float) -> bool:
    """Whether all pairs of classes are too much work, and mu has a range in which sums can be interpolated."""
    if model.is_homogeneous or model.n <= MANY_CLASSES or model.classes().count() <= MANY_CLASSES:
        return False
    try:
        interpolation.plan(model, names, tolerance)
    except (ValueError, OverflowError):
        return False
    return True


def _grid(model: Ensemble) -> interpolation.Pieces | None:
    """Few points that stand for all nodes in sums of up to three of them, if there are many classes and their range allows it."""
    if not _many(model, ("p", "p2"), TOLERANCE):
        return None
    try:
        return interpolation.grid(model, TOLERANCE / model.n**2)
    except (ValueError, OverflowError):
        return None


def _p(x: str, y: str) -> Column:
    return E.probability(-(F.col(x) + F.col(y)))


def node_sums(model: Ensemble, focal: DataFrame, first_only: bool = False) -> DataFrame:
    """(id, mu, d, s, m) of focal(id, mu): d = sum of p_ij, s of p_ij**2, m of p_ij d_j, over j other than i.

    Nodes with equal mu have equal sums, so they are computed for the focal classes and joined back; beyond MANY_CLASSES sums are interpolated, off by about TOLERANCE at most.
    """
    bound = TOLERANCE if first_only else TOLERANCE / model.n  # m adds up the errors of all degrees
    if _many(model, ("p", "p2"), bound):
        return interpolation.node_sums(model, focal, bound, first_only)[0]
    classes = spread(model.classes().select(F.col("mu").alias("mu_j"), "w"))
    own = E.probability(-2 * F.col("mu"))

    def sums(of: DataFrame) -> DataFrame:
        p = _p("mu", "mu_j")
        got = spread(of).crossJoin(classes).groupBy("mu").agg(F.sum(F.col("w") * p).alias("d"), F.sum(F.col("w") * p * p).alias("s"))
        return got.select("mu", (F.col("d") - own).alias("d"), (F.col("s") - own * own).alias("s"))

    mus = focal.select("mu").distinct()
    if first_only:
        return focal.join(sums(mus), "mu").select("id", "mu", "d", "s")
    degrees = sums(model.classes().select("mu"))
    other = degrees.join(model.classes(), "mu").select(F.col("mu").alias("mu_j"), F.col("d").alias("d_j"), "w")
    m = spread(mus).crossJoin(spread(other)).groupBy("mu").agg(F.sum(F.col("w") * _p("mu", "mu_j") * F.col("d_j")).alias("m"))
    found = m.join(degrees, "mu").select("mu", "d", "s", (F.col("m") - own * F.col("d")).alias("m"))
    return focal.join(found, "mu").select("id", "mu", "d", "s", "m")


def _homogeneous(model: Ensemble) -> dict[str, float]:
    n, p = model.n, model.p
    three, four = (n - 1) * (n - 2), (n - 1) * (n - 2) * (n - 3)
    return {
        "degree": p * (n - 1),
        "triangle": three * p**3 / 2,
        "twedge": three * p**2,
        "thead": three * p**2,
        "quadrangle": four * p**4 * (1 - p) ** 2 / 2,
        "qwedge": four * p**3,
        "qhead": four * p**3,
    }


def _placed(view: NodeView, values: DataFrame, names: list[str]) -> DataFrame:
    """The view's rows with the values of their ids: (pos, id, names)."""
    return view.rows().select("pos", "id").join(values, "id").select("pos", "id", *names)


def _spread(view: NodeView, values: dict[str, float]) -> DataFrame:
    """A homogeneous model's values: one row, or one for each selected node."""
    cols = [F.lit(v).cast("double").alias(k) for k, v in values.items()]
    return view.rows().select("pos", "id", *cols) if view.is_active else view.model.spark.range(1).select(*cols)


def degree(view: NodeView, normalize: bool = False, tolerance: float | None = None) -> DataFrame:
    """(pos, id, degree); a homogeneous model without selection has one row (degree).

    With a tolerance, and beyond MANY_CLASSES, sums are interpolated (see interpolation), in work proportional to the nodes, and off by that much, or TOLERANCE, at most before they are normalized; the column's metadata has the bound.
    """
    model = view.model
    if tolerance is None and _many(model, ("p", "p2"), TOLERANCE):
        tolerance = TOLERANCE
    scale = model.n if normalize else 1
    if model.is_homogeneous:
        return _spread(view, {"degree": _homogeneous(model)["degree"] / scale})
    if tolerance is not None:
        sums, bound = interpolation.node_sums(model, view.focal(), tolerance, first_only=True)
        return _placed(view, sums.select("id", (F.col("d") / scale).alias("degree", metadata={"error_bound": bound / scale})), ["degree"])
    sums = node_sums(model, view.focal(), first_only=True)
    return _placed(view, sums.select("id", (F.col("d") / scale).alias("degree")), ["degree"])


def _estimated(names: tuple[str, ...], draws: int, scale: int) -> list[Column]:
    """Columns whose metadata say that they are estimates, and from how many draws."""
    return [(F.col(k) / scale).alias(k, metadata={"estimate": True, "draws": draws}) for k in names]


def motifs(view: NodeView, names: tuple[str, ...] = TRIANGLE + QUADRANGLE, normalize: bool = False, **mc) -> DataFrame:
    """(pos, id, names): expected counts; exact up to options' mc_above nodes, else by Monte Carlo, with a warning unless it is asked for.

    mc=draws asks for Monte Carlo, mc=False for the exact sums; seed, repeat and average as in kernels.monte_carlo.  by="classes"
    does either for each distinct mu (see classes) rather than for each node, whose draws differ; without it nodes are taken while there are at most
    mc_nodes of them, and exact sums choose what is less work.  Columns of estimates have metadata that say so.
    """
    model = view.model
    scale = model.n if normalize else 1
    by = mc.pop("by", None)
    if by not in (None, "nodes", "classes"):
        raise ValueError(f"motifs are counted by nodes or classes, not {by!r}")
    if model.is_homogeneous:
        all_ = _homogeneous(model)
        return _spread(view, {k: all_[k] / scale for k in names})
    if model.n < 4 and (none := [k for k in names if model.n < (3 if k in TRIANGLE else 4)]):
        # too few nodes for the motif: exactly 0, which the difference of sums would miss by rounding
        rest = tuple(k for k in names if k not in none)
        found = motifs(view, rest, normalize, by=by, **mc) if rest else view.rows().select("pos", "id")
        return found.select("*", *[F.lit(0.0).alias(k) for k in none]).select(*[c for c in ("pos", "id", "rep") if c in found.columns], *names)
    draws = mc.pop("mc", None)
    if draws is None:
        draws = options.get("mc_draws") if model.n > options.get("mc_above") and not set(names) <= {"twedge", "thead"} else False
        if draws:
            warnings.warn(f"{model.n} nodes are more than mc_above: counts are estimates from {draws} draws a node; mc=False asks for exact sums", stacklevel=2)
    if draws:
        if by == "classes" or (by is None and model.n > options.get("mc_nodes")):
            settings = {"seed": 0, "repeat": options.get("mc_repeat"), "average": True, "same_seed": True} | {k: v for k, v in mc.items() if v is not None}
            values = classes.monte_carlo(model, view.focal(), names, draws, sums=lambda of: node_sums(model, of), **settings)
        else:
            degrees = node_sums(model, model.all_nodes, first_only=True).select("id", "mu", "d") if kernels.OF_DEGREES & set(names) else None
            values = kernels.monte_carlo(model, view.focal(), names, draws, degrees=degrees, **mc)
        rep = ["rep"] if "rep" in values.columns else []
        return _placed(view, values.select("id", *rep, *_estimated(names, draws, scale)), [*rep, *names])
    sums = node_sums(model, view.focal())
    values = sums.select("id", "mu", "d", "s", "m", (F.col("d") * F.col("d") - F.col("s")).alias("twedge"), (F.col("m") - F.col("s")).alias("thead"))
    if hard := [k for k in names if k not in ("twedge", "thead")]:
        if pieces := _grid(model):
            values = values.join(interpolation.motifs(model, view.focal(), hard, pieces), "mu")
        elif by == "classes" or (by is None and _fewer_classes(model, hard)):
            values = values.join(classes.exact(model, view.focal(), hard, lambda of: node_sums(model, of), options.get("exact_nodes")), "mu")
        else:
            whole = node_sums(model, model.all_nodes) if {"qwedge", "qhead"} & set(hard) else None
            values = values.join(kernels.exact(model, view.focal(), hard, whole), "id")
    return _placed(view, values.select("id", *[(F.col(k) / scale).alias(k) for k in names]), list(names))


def motif_gradient(view: NodeView, name: str, normalize: bool = False) -> DataFrame:
    """(pos, id, gradient): the derivative of the sum over all nodes of a count (degree, twedge, thead, triangle) by each selected node's mu; normalized: of their mean.

    Analytic: each edge's probability p has the derivative p (1 - p), and sums go by classes of mu.  In a homogeneous model each node has half of mu.
    """
    model = view.model
    if model.is_homogeneous:
        model = Ensemble.heterogeneous(model.all_nodes.select("id", (F.col("mu") / 2).alias("mu")))
        view = NodeView(model, view.index)
    scale = model.n if normalize else 1
    focal = view.rows().select("id", "mu").distinct()
    found = classes.gradient(model, focal, name, lambda of: node_sums(model, of), options.get("exact_nodes"))
    return _placed(view, focal.join(found, "mu").select("id", (F.col("gradient") / scale).alias("gradient")), ["gradient"])


def _fewer_classes(model: Ensemble, names: list[str]) -> bool:
    """Whether sums over classes are less work than the kernels', or the kernels have too many nodes; blocks of squares are the slower ones."""
    k = model.classes().count()
    return model.n > options.get("exact_nodes") or (4 * k**4 < model.n**4 if "quadrangle" in names else 2 * k < model.n)


def coefficient_columns(names: tuple[str, ...], prefix: str = "") -> list[Column]:
    """Ratios of counts, within [0, 1]; null where a denominator is 0."""
    out = []
    for k in names:
        top, factor, below = COEFFICIENTS[k]
        bottom = sum((F.col(prefix + b) for b in below[1:]), F.col(prefix + below[0]))
        out.append(E.ratio(factor * F.col(prefix + top), bottom).alias(k))
    return out


def coefficients(view: NodeView, names: tuple[str, ...], **mc) -> DataFrame:
    """(pos, id, names): ratios of expected counts; numerators and denominators share their random draws."""
    need = tuple(dict.fromkeys(m for k in names for m in (COEFFICIENTS[k][0], *COEFFICIENTS[k][2])))
    counts = motifs(view, need, **mc)
    return counts.select(*[c for c in ("pos", "id", "rep") if c in counts.columns], *coefficient_columns(names))


def tstats(view: NodeView, **mc) -> DataFrame:
    return coefficients(view, ("tclust", "tclosure", "similarity"), **mc)


def qstats(view: NodeView, **mc) -> DataFrame:
    return coefficients(view, ("qclust", "qclosure", "complementarity"), **mc)


def node_free_energy(view: NodeView, normalize: bool = False, tolerance: float | None = None) -> DataFrame:
    """(pos, id, free_energy): half the sum of ln(1 - p_ij); tolerance as for degree()."""
    model = view.model
    if tolerance is None and _many(model, ("free",), 2 * TOLERANCE):
        tolerance = TOLERANCE
    scale = model.n if normalize else 1
    if model.is_homogeneous:
        one = model.spark.range(1).select(((model.n - 1) / 2 * E.edge_free_energy(F.lit(-model.mu)) / scale).alias("free_energy"))
        return view.rows().select("pos", "id").crossJoin(F.broadcast(one)) if view.is_active else one
    if tolerance is not None:
        found, bound = interpolation.node_free_energy(model, view.focal(), tolerance)
        return _placed(view, found.select("id", (F.col("free_energy") / scale).alias("free_energy", metadata={"error_bound": bound / scale})), ["free_energy"])
    classes = spread(model.classes().select(F.col("mu").alias("mu_j"), "w"))
    own = E.edge_free_energy(-2 * F.col("mu"))
    sums = spread(view.focal().select("mu").distinct()).crossJoin(classes).groupBy("mu").agg(F.sum(F.col("w") * E.edge_free_energy(-(F.col("mu") + F.col("mu_j")))).alias("f"))
    values = view.focal().join(sums, "mu").select("id", ((F.col("f") - own) / 2 / scale).alias("free_energy"))
    return _placed(view, values, ["free_energy"])


# One-row statistics of the graph


def edge_count(model: Ensemble, normalize: bool = False, tolerance: float | None = None) -> DataFrame:
    """(edge_count); tolerance: of each node's degree, as for degree()."""
    scale = model.n if normalize else 1
    d = degree(model.nodes, tolerance=tolerance)
    total = F.col("degree") * model.n / 2 if model.is_homogeneous else F.sum("degree") / 2
    return d.select((total / scale).alias("edge_count")) if model.is_homogeneous else d.agg((total / scale).alias("edge_count"))


def edge_density(model: Ensemble, tolerance: float | None = None) -> DataFrame:
    """Expected share of pairs that are edges; null for a single node."""
    return edge_count(model, tolerance=tolerance).select(F.try_divide(2 * F.col("edge_count"), F.lit(float(model.n * (model.n - 1)))).alias("edge_density"))


def free_energy(model: Ensemble, normalize: bool = False, tolerance: float | None = None) -> DataFrame:
    """Sum of ln(1 - p_ij) over pairs i < j; its negative is the log-partition function.  tolerance: of each node's half."""
    f = node_free_energy(model.nodes, tolerance=tolerance)
    scale = model.n if normalize else 1
    total = F.col("free_energy") * model.n if model.is_homogeneous else None
    return f.select((total / scale).alias("free_energy")) if model.is_homogeneous else f.agg((F.sum("free_energy") / scale).alias("free_energy"))


def log_partition(model: Ensemble, tolerance: float | None = None) -> DataFrame:
    return free_energy(model, tolerance=tolerance).select((-F.col("free_energy")).alias("log_partition"))


def free_energy_gradient(view: NodeView, tolerance: float | None = None) -> DataFrame:
    """(pos, id, gradient): derivative of the free energy by mu_i, the negative expected degree (by theta: the degree)."""
    d = degree(view, tolerance=tolerance)
    return d.select(*[c for c in d.columns if c != "degree"], (-F.col("degree")).alias("gradient"))


def moment(view: NodeView, name: str, order: int = 1, **options) -> DataFrame:
    """Expectations; moments other than the first are not defined."""
    if order != 1:
        raise NotImplementedError(f"moment {order} of {name}")
    if name == "degree":
        if options.get("mc"):
            raise ValueError("the degree has no Monte Carlo estimate")
        return degree(view, **{k: v for k, v in options.items() if k != "mc"})
    return coefficients(view, (name,), **options) if name in COEFFICIENTS else motifs(view, (name,), **options)
