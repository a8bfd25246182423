"""Sums of a caller's kernel over all tuples of nodes, exact or by importance sampling.

A kernel is a function of columns: it gets the focal node and the iterated nodes, each
a struct (id, mu), and returns a column.  The exact sum is a fold of cross joins,
n**order terms for each focal node; products of functions of the focal node and one other
take n terms, and built-in motifs have cheaper plans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..plans import options
from ..plans.model import NodeView, spread
from ..sources.checkpoints import cut
from . import geometry, interpolation, kernels, lines

Kernel = Callable[..., Column]

#: Paths in a batch.
PATHS = 1 << 14


def pair_probability(a: Column, b: Column) -> Column:
    """p of two nodes, 0 for a node and itself."""
    return F.when(a["id"] == b["id"], F.lit(0.0)).otherwise(E.probability(-(a["mu"] + b["mu"])))


def _others(names: list[str], k: int, unique: bool | str) -> list[str]:
    """The nodes that the k-th one must not be: all before it, or, for "earlier", all before the last of these; weights may allow that one."""
    if unique not in (True, False, "earlier"):
        raise ValueError(f"unique is True, False or 'earlier', not {unique!r}")
    return names[: k - 1] if unique == "earlier" else names[:k] if unique else []


def _distinct(names: list[str], k: int, unique: bool | str = True) -> Column:
    out = F.lit(True)
    for other in _others(names, k, unique):
        out = out & (F.col(names[k])["id"] != F.col(other)["id"])
    return out


def iterate(view: NodeView, order: int, kernel: Kernel, unique: bool = True) -> DataFrame:
    """(id, value): kernel(focal, v1, …, v_order) summed over all nodes; unique: over distinct ones, the focal included."""
    names = ["v0", *(f"v{k}" for k in range(1, order + 1))]
    node = F.struct("id", "mu")
    rows = view.focal().select(node.alias("v0"))
    for k in range(1, order + 1):
        other = view.model.all_nodes.select(node.alias(names[k]))
        rows = rows.join(other, _distinct(names, k)) if unique else rows.crossJoin(other)
    return rows.groupBy(F.col("v0.id").alias("id")).agg(F.sum(kernel(*[F.col(x) for x in names])).alias("value"))


def _partitions(items: list[int]) -> list[list[list[int]]]:
    """All ways to part items into sets."""
    if not items:
        return [[]]
    first, *rest = items
    out = []
    for parts in _partitions(rest):
        out.append([[first], *parts])
        out += [[*parts[:k], [first, *p], *parts[k + 1 :]] for k, p in enumerate(parts)]
    return out


def iterate_product(view: NodeView, factors: list[Kernel], unique: bool = True) -> DataFrame:
    """iterate() of a kernel that is a product of functions of the focal node and one other node each, in n terms for each focal node.

    Without uniqueness that is the product of the factors' sums.  Over distinct nodes, tuples in which some coincide are taken off: for each way to part the factors into
    sets, the sums of the sets' products, with sign and weight (-1)**(size - 1) * (size - 1)! of each set.
    """
    ways = _partitions(list(range(len(factors)))) if unique else [[[k] for k in range(len(factors))]]
    sets = sorted({tuple(p) for parts in ways for p in parts})
    node, name = F.struct("id", "mu"), lambda p: "s_" + "_".join(map(str, p))
    if not sets:
        return view.focal().select("id", F.lit(1.0).alias("value"))
    a = spread(view.focal()).select(node.alias("v0"))
    b = spread(view.model.all_nodes).select(node.alias("v1"))
    pairs = a.join(b, F.col("v0")["id"] != F.col("v1")["id"]) if unique else a.crossJoin(b)
    each = pairs.select(F.col("v0.id").alias("id"), *[f(F.col("v0"), F.col("v1")).alias(f"f_{k}") for k, f in enumerate(factors)])
    sums = each.groupBy("id").agg(*[F.sum(math.prod(F.col(f"f_{k}") for k in p)).alias(name(p)) for p in sets])
    value = sum(math.prod((-1) ** (len(p) - 1) * math.factorial(len(p) - 1) * F.col(name(tuple(p))) for p in parts) for parts in ways)
    return sums.select("id", value.alias("value"))


def iterate_sampled(view: NodeView, order: int, kernel: Kernel, weights: list[Kernel], draws: int, seed: int = 0, unique: bool | str = True) -> DataFrame:
    """(id, value): an estimate of iterate(): at each depth, draws nodes with replacement in proportion to that depth's weight kernel.

    weights[k] gets the focal node and the nodes up to depth k + 1.  A tuple's value is divided by its weights' share,
    so it counts as many times as its weight is rare.  unique="earlier" keeps a node from being drawn again only once another one has been drawn after it.
    Each path meets all nodes at each depth; iterate_ranged() does not.
    """
    names = ["v0", *(f"v{k}" for k in range(1, order + 1))]
    node = F.struct("id", "mu")
    rows = view.focal().select(node.alias("v0"), F.lit("").alias("path"), F.lit(1.0).alias("factor"))
    for k in range(1, order + 1):
        other = view.model.all_nodes.select(node.alias(names[k]))
        each = rows.join(other, _distinct(names, k, unique)) if _others(names, k, unique) else rows.crossJoin(other)
        each = each.withColumn("w", weights[k - 1](*[F.col(x) for x in names[: k + 1]])).where("w > 0")
        group = Window.partitionBy("v0.id", "path")
        each = each.withColumns({"total": F.sum("w").over(group), "upto": F.sum("w").over(group.orderBy(F.col(names[k])["id"]).rowsBetween(Window.unboundedPreceding, 0))})
        # the draws that fall into a node's part of the line from 0 to 1
        draw = F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: (
            (E.hash_uniform(seed, F.col("v0.id"), F.col("path"), d) >= (F.col("upto") - F.col("w")) / F.col("total"))
            & (E.hash_uniform(seed, F.col("v0.id"), F.col("path"), d) < F.col("upto") / F.col("total"))
        ))
        each = each.withColumn("draw", F.explode(draw))
        rows = each.select(*names[: k + 1], F.concat_ws("/", "path", F.col("draw").cast("string")).alias("path"), (F.col("factor") * F.col("total") / F.col("w") / draws).alias("factor"))
    got = rows.groupBy(F.col("v0.id").alias("id")).agg(F.sum(F.col("factor") * kernel(*[F.col(x) for x in names])).alias("value"))
    return view.focal().select("id").join(got, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def iterate_ranged(view: NodeView, order: int, kernel: Kernel, weight: Kernel, draws: int, seed: int = 0, unique: bool | str = True) -> DataFrame:
    """iterate_sampled() for weights that are a function of the last node and the next one, in work proportional to the paths.

    Each node's cumulative weights are summed and stored once, in order of id and cut into as many equal cells as there are nodes, and a draw meets its range by node and
    cell.  Nodes that must not be drawn are skipped by their own ranges: a draw is a point of the line without them, and moves up by each range that it is not below.
    Of many nodes no range is stored if the weight is pair_probability: few points stand for them (see lines).
    """
    _others([], 0, unique)
    if weight is pair_probability and not view.model.is_homogeneous and lines.LEAST < view.model.n <= options.get("mc_nodes"):
        low, high = view.model.all_nodes.agg(F.min("mu"), F.max("mu")).first()
        if pieces := lines.pieces_of(low, high, view.model.n):
            return _iterate_lines(view, order, kernel, pieces, draws, seed, unique)
    names = ["v0", *(f"v{k}" for k in range(1, order + 1))]
    node, n = F.struct("id", "mu"), view.model.n
    pairs = spread(view.model.all_nodes.select(node.alias("a"))).crossJoin(view.model.all_nodes.select(node.alias("b")))
    pairs = pairs.withColumn("w", weight(F.col("a"), F.col("b"))).where("w > 0").select(F.col("a.id").alias("last"), F.col("b.id").alias("next"), "b", "w")
    line = Window.partitionBy("last").orderBy("next")
    pairs = pairs.withColumn("upto", F.sum("w").over(line))
    pairs = cut(pairs.withColumns({"low": F.lag("upto", 1, 0.0).over(line), "total": F.max("upto").over(Window.partitionBy("last"))}))
    cell = lambda x: F.least(F.floor(x / F.col("total") * n), F.lit(n - 1)).cast("int")
    guide = cut(pairs.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("upto"))))).drop("total"))
    totals, ranges = pairs.groupBy("last").agg(F.first("total").alias("total")), pairs.select("last", F.col("next").alias("gone"), F.struct("low", "w").alias("range"))
    rows = view.focal().select(node.alias("v0"), F.lit("").alias("path"), F.lit(1.0).alias("factor"))
    for k in range(1, order + 1):
        each = rows.withColumn("last", F.col(names[k - 1])["id"]).join(totals, "last")
        gone = []
        for other in _others(names, k, unique):
            column = f"{other}_range"
            each = each.withColumn("gone", F.col(other)["id"]).join(ranges.withColumnRenamed("range", column), ["last", "gone"], "left").drop("gone")
            gone.append(column)
        skipped = F.array_sort(F.array_distinct(F.array_compact(F.array(*gone)))) if gone else F.array().cast("array<struct<low:double,w:double>>")
        each = each.withColumn("skipped", skipped).drop(*gone)
        left = F.col("total") - F.aggregate("skipped", F.lit(0.0), lambda s, r: s + r["w"])
        each = each.withColumn("left", left).where("left > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        x = F.aggregate("skipped", E.hash_uniform(seed, F.col("v0.id"), F.col("path"), F.col("draw")) * F.col("left"), lambda s, r: s + F.when(s >= r["low"], r["w"]).otherwise(0.0))
        each = each.withColumn("x", x).withColumn("cell", cell(F.col("x"))).join(guide, ["last", "cell"]).where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("upto")))
        path, factor = F.concat_ws("/", "path", F.col("draw").cast("string")), F.col("factor") * F.col("left") / F.col("w") / draws
        rows = each.select(*names[:k], F.col("b").alias(names[k]), path.alias("path"), factor.alias("factor"))
    got = rows.groupBy(F.col("v0.id").alias("id")).agg(F.sum(F.col("factor") * kernel(*[F.col(x) for x in names])).alias("value"))
    return view.focal().select("id").join(got, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _iterate_lines(view: NodeView, order: int, kernel: Kernel, pieces: interpolation.Pieces, draws: int, seed: int, unique: bool | str) -> DataFrame:
    """iterate_ranged() for pair_probability: a task walks all paths of its focal nodes, and nothing is stored for pairs."""
    shared = view.model.spark.sparkContext.broadcast(kernels._parameters(view.model, options.get("mc_nodes")))
    names = [f"v{k}" for k in range(order + 1)]
    schema = ", ".join([*[f"{x}_id long, {x}_mu double" for x in names], "factor double"])

    def walked(line: lines.Line, ids: np.ndarray, focal: int) -> Iterator[tuple[tuple[int, ...], float]]:
        """Places of a path's nodes, and its factor."""
        paths = [((focal,), "", 1.0)]
        for k in range(1, order + 1):
            longer = []
            for nodes, path, factor in paths:
                mu = line.mu[nodes[-1]]
                # a node has no chance with itself
                without = {nodes[-1], *(nodes[names.index(x)] for x in _others(names, k, unique))}
                left, at, p = line.drawn(lambda x, mu=mu: lines.sigmoid(mu + x), list(without), np.array([kernels.uniform(seed, ids[focal], path, r) for r in range(draws)]))
                each = zip(at.tolist(), (factor * left / p / draws).tolist(), strict=True)
                longer += [((*nodes, a), f"{path}/{r}", f) for r, (a, f) in enumerate(each)]
            paths = longer
        for nodes, _, factor in paths:
            yield nodes, factor

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, line = shared.value["id"], lines.Line(shared.value["mu"], pieces)

        def frame(found: list[tuple[tuple[int, ...], float]]) -> pd.DataFrame:
            at = np.array([nodes for nodes, _ in found], dtype=np.int64).reshape(-1, order + 1)
            columns = {f"{x}_{c}": v[at[:, k]] for k, x in enumerate(names) for c, v in (("id", ids), ("mu", line.mu))}
            return pd.DataFrame(columns | {"factor": [factor for _, factor in found]})

        for part in parts:
            held = []
            for i in part["id"]:
                for one in walked(line, ids, int(np.searchsorted(ids, i))):
                    held.append(one)
                    if len(held) == PATHS:
                        yield frame(held)
                        held = []
            yield frame(held)

    parts = max(1, min(view.model.spark.sparkContext.defaultParallelism * 4, -(-view.model.n // 8)))
    rows = view.focal().select("id").repartition(parts, "id").mapInPandas(run, schema)
    rows = rows.select(*[F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_mu").alias("mu")).alias(x) for x in names], "factor")
    got = rows.groupBy(F.col("v0.id").alias("id")).agg(F.sum(F.col("factor") * kernel(*[F.col(x) for x in names])).alias("value"))
    return view.focal().select("id").join(got, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def pairwise(points: DataFrame, func: Callable[[Column, Column], Column], other: DataFrame | None = None, condensed: bool = True) -> DataFrame:
    """(i, j, value) of a function of the columns x of two rows of points(id, x): i < j, all pairs, or all with other."""
    a = points.select(F.col("id").alias("i"), F.col("x").alias("x_i"))
    b = (points if other is None else other).select(F.col("id").alias("j"), F.col("x").alias("x_j"))
    both = a.join(b, F.col("i") < F.col("j")) if condensed and other is None else a.crossJoin(b)
    return both.select("i", "j", func(F.col("x_i"), F.col("x_j")).alias("value"))


def pairwise_blocks(points: DataFrame, func: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """pairwise() of i < j for a function of two matrices of points, which gives a row for each of the first and a column for each of the second; all x have the same length."""
    return geometry.pair_rows(geometry.block_pairs(points), func, "value")


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed absolute differences, component by component."""
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        total += np.abs(a[:, None] - b)
    return total


def squareform(condensed: DataFrame, value: str = "value") -> DataFrame:
    """Both directions of (i, j, value)."""
    return condensed.select("i", "j", value).union(condensed.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def split_by(data: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, values): the values of each group in order."""
    return data.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def batch_slices(n: Column, size: int) -> Column:
    """Array of (start, stop) that cut n items into runs of size, the last one shorter."""
    if size <= 0:
        raise ValueError("the size of a batch must be positive")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("stop")))
