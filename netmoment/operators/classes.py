"""Motif counts by classes of mu: nodes with equal parameters have equal expectations, so K classes with their multiplicities stand for all n nodes.

Sums over distinct nodes are sums over classes from which the terms of coinciding nodes are taken.  Triangles are
sums over pairs of classes for each class, K**3 terms, and chordless squares K**4.  Classes are dealt out in blocks, as arrays; a row of the work
is a combination of blocks and a few matrix products, and rows add up by focal class.  So a task holds a few blocks and nothing is
broadcast or bounded by n.  Wedges and heads are sums of K**2 columns.

Monte Carlo draws the class of a random neighbour: a class's cumulative weights are a guide table, one row for each piece of a class's part of the line from
0 to 1 within one of K equal cells, which a draw meets by its cell; nodes of a class are alike, so the member
drawn need not be known.  What a draw is worth depends on the two classes only and is summed once for each pair of classes that is drawn.
Up to FEW_CLASSES classes, tasks get the classes and nodes in order of mu, and draw and sum by themselves: no draw is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import expr as E
from ..plans.model import Ensemble, spread
from ..sources.checkpoints import cut, numbered

#: Classes in a block, of triangles and of squares; a square's task holds two arrays of the third power.
SIDE, SQUARE_SIDE = 256, 64
#: Classes up to which each task of Monte Carlo has all of them, and draws that a task makes at once.
FEW_CLASSES, AT_ONCE = 4096, 1 << 18
#: Classes up to which such a task keeps the probabilities of all pairs of them, and rows of these that it makes at once otherwise.
WHOLE, ROWS = 1024, 256
#: Blocks there are at least, as far as there are classes, so that all cores have some.
LEAST_BLOCKS = 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def numbered_classes(model: Ensemble) -> DataFrame:
    """(c, mu, w): the distinct parameters in order, and how many nodes have them."""
    return cut(numbered(model.classes(), "c", "mu").select("c", "mu", "w"))


def blocks(classes: DataFrame, side: int, name: str) -> DataFrame:
    """(name, name_c, name_mu, name_w): side classes in a row, as arrays."""
    rows = classes.groupBy(F.floor(F.col("c") / side).cast("long").alias(name)).agg(F.array_sort(F.collect_list(F.struct("c", "mu", "w"))).alias("r"))
    return rows.select(name, F.col("r.c").alias(f"{name}_c"), F.col("r.mu").alias(f"{name}_mu"), F.transform("r.w", lambda w: w.cast("double")).alias(f"{name}_w"))


Part = Callable[[dict[str, np.ndarray]], np.ndarray]


def _worked(names: str, part: Part):
    """Sums of part over a task's rows, by focal class; a row's columns come as arrays, 'a_mu' and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for b in batches:
            columns = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            for r in range(b.num_rows):
                row = {k: v[r].as_py() if pa.types.is_integer(v.type) else v[r].values.to_numpy(zero_copy_only=False) for k, v in columns.items()}
                for c, x in zip(row["a_c"].tolist(), part(row).tolist(), strict=True):
                    total[c] = total.get(c, 0.0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["c", "x"])

    return run


def _summed(classes: DataFrame, focal: DataFrame, side: int, names: str, part: Part) -> DataFrame:
    """(c, x): for each focal class the sum of part over all combinations of blocks, the last two in one order only."""
    rows = blocks(focal, side, "a")
    for name in names[1:]:
        rows = rows.crossJoin(blocks(classes, side, name))
    y, z = names[-2:]
    return spread(rows.where(F.col(y) <= F.col(z))).mapInArrow(_worked(names, part), "c long, x double").groupBy("c").agg(F.sum("x").alias("x"))


def _triangles(r: dict) -> np.ndarray:
    """Sums over classes b and c of p_ab p_bc p_ac."""
    ab, ac, bc = _sigmoid(r["a_mu"][:, None] + r["b_mu"]), _sigmoid(r["a_mu"][:, None] + r["c_mu"]), _sigmoid(r["b_mu"][:, None] + r["c_mu"])
    return ((ab * r["b_w"]) @ bc * (ac * r["c_w"])).sum(1) * (1 if r["b"] == r["c"] else 2)


def _squares(r: dict) -> np.ndarray:
    """Sums over opposite classes k of open pairs of nodes of classes b and c that neighbour both; no node twice."""
    ak = _sigmoid(r["a_mu"][:, None] + r["k_mu"])
    once = r["a_c"][:, None] == r["k_c"]

    def common(x: str) -> tuple[np.ndarray, np.ndarray]:
        """p_ax p_kx, and how many nodes of x are neither the focal one nor the opposite one."""
        p = _sigmoid(r["a_mu"][:, None] + r[f"{x}_mu"])[:, None, :] * _sigmoid(r["k_mu"][:, None] + r[f"{x}_mu"])[None]
        w = r[f"{x}_w"][None, None] - (r["a_c"][:, None] == r[f"{x}_c"])[:, None, :] - (r["k_c"][:, None] == r[f"{x}_c"])[None]
        return p, w

    p, w = common("b")
    q, v = (p, w) if r["b"] == r["c"] else common("c")
    open_ = 1 - _sigmoid(r["b_mu"][:, None] + r["c_mu"])
    y, z = p * w, q * v
    pairs = ((y.reshape(-1, y.shape[2]) @ open_).reshape(z.shape) * z).sum(2)
    if r["b"] == r["c"]:
        pairs -= (w * p * p) @ np.diag(open_)  # a node and itself
    else:
        pairs *= 2
    return ((r["k_w"] - once) * (1 - ak) * pairs).sum(1) / 2


def _side(k: int, most: int) -> int:
    return max(1, min(most, -(-k // LEAST_BLOCKS)))


def exact(model: Ensemble, focal: DataFrame, names: list[str], sums: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """(mu, names) of the distinct mu of focal, for names among triangle, quadrangle, qwedge, qhead; sums: see stats.node_sums, of (id, mu).

    More than most classes are refused: they need at least the third power of their number.
    """
    classes = numbered_classes(model)
    k = classes.count()
    if k > most:
        raise ValueError(f"{k} classes of mu are more than exact sums take ({most}); round parameters or ask for Monte Carlo")
    wanted = classes.join(focal.select("mu").distinct(), "mu").select("c", "mu", "w")
    p, own = E.probability(-(F.col("mu") + F.col("mu_j"))), E.probability(-2 * F.col("mu"))
    out = wanted
    paths = {"triangle", "qwedge", "qhead"} & set(names)
    if paths:
        other = classes.select(F.col("mu").alias("mu_j"), F.col("w").alias("w_j"))
        # j and k at one node, and either at the focal one
        pp = E.probability(-2 * F.col("mu_j"))
        two = spread(wanted).crossJoin(spread(other)).groupBy("c").agg(F.sum(F.col("w_j") * p * p).alias("s2"), F.sum(F.col("w_j") * p * p * pp).alias("s3"))
        three = _summed(classes, wanted, _side(k, SIDE), "abc", _triangles)
        t = (F.col("x") - 2 * own * F.col("s2") - F.col("s3") + 2 * own * own * own) / 2
        out = out.join(three.join(two, "c").select("c", "x", "s2", "s3"), "c").select("c", "mu", "w", t.alias("triangle"))
    if {"qwedge", "qhead"} & set(names):
        all_sums = cut(sums(classes.select(F.col("c").alias("id"), "mu")).select(F.col("id").alias("c"), "mu", "d", "s", "m"))
        focal_sums = out.join(all_sums.drop("mu"), "c")
        other = all_sums.join(classes.select("c", "w"), "c").select(F.col("mu").alias("mu_j"), F.col("w").alias("w_j"), F.col("d").alias("d_j"), F.col("s").alias("s_j"), F.col("m").alias("m_j"))
        wedge = lambda x, d: x * (F.col("d") - x) * (d - x)
        head = lambda x, s, m: x * (m - x * F.col("d") - s + x * x)
        terms = spread(focal_sums).crossJoin(spread(other)).groupBy("c", "mu", "w", "triangle", "d", "s", "m").agg(
            F.sum(F.col("w_j") * wedge(p, F.col("d_j"))).alias("wedge"), F.sum(F.col("w_j") * head(p, F.col("s_j"), F.col("m_j"))).alias("head")
        )
        out = terms.select(
            "c", "mu", "w", "triangle", (F.col("wedge") - wedge(own, F.col("d")) - 2 * F.col("triangle")).alias("qwedge"),
            (F.col("head") - head(own, F.col("s"), F.col("m")) - 2 * F.col("triangle")).alias("qhead"),
        )
    if "quadrangle" in names:
        four = _summed(classes, wanted, _side(k, SQUARE_SIDE), "akbc", _squares)
        out = out.join(four.select("c", F.col("x").alias("quadrangle")), "c")
    return out.select("mu", *names)


def _triangle_slopes(r: dict) -> np.ndarray:
    """Sums over classes b and c of p_ab (1 - p_ab) p_bc p_ac, in both orders of b and c."""
    ab, ac, bc = _sigmoid(r["a_mu"][:, None] + r["b_mu"]), _sigmoid(r["a_mu"][:, None] + r["c_mu"]), _sigmoid(r["b_mu"][:, None] + r["c_mu"])
    total = ((ab * (1 - ab) * r["b_w"]) @ bc * (ac * r["c_w"])).sum(1)
    return total if r["b"] == r["c"] else total + ((ab * r["b_w"]) @ bc * (ac * (1 - ac) * r["c_w"])).sum(1)


def gradient(model: Ensemble, focal: DataFrame, name: str, sums: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """(mu, gradient) of the distinct mu of focal: the derivative, by the mu of one node, of the sum of a count over all nodes, for degree, twedge, thead and triangle."""
    classes = numbered_classes(model)
    k = classes.count()
    if k > most and name == "triangle":
        raise ValueError(f"{k} classes of mu are more than exact sums take ({most}); round parameters")
    wanted = classes.join(focal.select("mu").distinct(), "mu").select("c", "mu", "w")
    other = classes.select(F.col("mu").alias("mu_j"), F.col("w").alias("w_j"))
    p, own = E.probability(-(F.col("mu") + F.col("mu_j"))), E.probability(-2 * F.col("mu"))
    slope = lambda x: x * (1 - x)
    if name == "degree":  # each edge counts at both ends
        return sums(wanted.select(F.col("c").alias("id"), "mu")).select("mu", (2 * (F.col("d") - F.col("s"))).alias("gradient"))
    if name in ("twedge", "thead"):  # each path is a wedge at its middle and a head at its ends: all wedges are as many as all heads
        degrees = cut(sums(classes.select(F.col("c").alias("id"), "mu")).select("mu", "d"))
        ends = other.join(degrees.select(F.col("mu").alias("mu_j"), F.col("d").alias("d_j")), "mu_j")
        term = slope(p) * (2 * (F.col("d") - p) + 2 * (F.col("d_j") - p))
        total = spread(wanted.join(degrees, "mu")).crossJoin(spread(ends)).groupBy("mu", "d").agg(F.sum(F.col("w_j") * term).alias("q"))
        return total.select("mu", (F.col("q") - slope(own) * 4 * (F.col("d") - own)).alias("gradient"))
    if name != "triangle":
        raise NotImplementedError(f"no gradient of {name}")
    pp = E.probability(-2 * F.col("mu_j"))
    two = spread(wanted).crossJoin(spread(other)).groupBy("c").agg(
        F.sum(F.col("w_j") * p * p).alias("s2"), F.sum(F.col("w_j") * slope(p) * p).alias("r"), F.sum(F.col("w_j") * slope(p) * p * pp).alias("u")
    )
    three = _summed(classes, wanted, _side(k, SIDE), "abc", _triangle_slopes)
    found = wanted.join(three, "c").join(two, "c")
    # a triangle counts at each of its nodes
    return found.select("mu", (3 * (F.col("x") - slope(own) * F.col("s2") - own * F.col("r") - F.col("u") + 2 * slope(own) * own * own)).alias("gradient"))


# Monte Carlo


def guide(classes: DataFrame, focal: DataFrame, weight: Column, by: list[str]) -> tuple[DataFrame, int]:
    """(by, cell, mu_j, low, high, total): the parts of the line from 0 to 1 that classes have in order of mu, cut at the edges of as many equal cells as there are classes; and that number.

    weight: of the columns of focal, and mu_j and w_j of a class.
    """
    k = classes.count()
    each = spread(focal).crossJoin(classes.select(F.col("c").alias("c_j"), F.col("mu").alias("mu_j"), F.col("w").cast("double").alias("w_j"))).withColumn("weight", weight).where("weight > 0")
    order = Window.partitionBy(*by).orderBy("c_j")
    each = each.withColumn("upto", F.sum("weight").over(order))
    each = each.withColumns({"before": F.lag("upto", 1, 0.0).over(order), "total": F.max("upto").over(Window.partitionBy(*by))})
    low, high = F.col("before") / F.col("total"), F.col("upto") / F.col("total")
    cells = F.sequence(F.floor(low * k).cast("int"), F.least(F.floor(high * k), F.lit(k - 1)).cast("int"))
    return each.select(*by, "mu_j", "w_j", "total", low.alias("low"), high.alias("high"), F.explode(cells).alias("cell")), k


def drawn(draws: DataFrame, table: DataFrame, k: int, by: list[str], u: str = "u") -> DataFrame:
    """draws(by, u) with the mu_j and total of the class that u falls on."""
    placed = draws.withColumn("cell", F.floor(F.col(u) * k).cast("int")).hint("merge")  # draws are many more than the planner takes them for
    return placed.join(table, [*by, "cell"]).where((F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))).drop("cell", "low", "high", "w_j")


def monte_carlo(model: Ensemble, focal: DataFrame, names: tuple[str, ...], draws: int, seed: int, repeat: int, average: bool, same_seed: bool, sums: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id[, rep], names): estimates from draws random neighbours of each node and repetition, by class; see kernels.monte_carlo for the arguments."""
    if draws <= 0 or repeat <= 0:
        raise ValueError("draws and repetitions must be positive")
    classes = numbered_classes(model)
    if classes.count() <= FEW_CLASSES:
        return _drawn_in_tasks(classes, focal, names, draws, seed, repeat, average, same_seed, sums)
    p_j = E.probability(-(F.col("mu") + F.col("mu_j")))
    mus = focal.select("mu").distinct()
    # the focal node is not its own neighbour
    table, k = guide(classes, mus, (F.col("w_j") - (F.col("mu") == F.col("mu_j")).cast("double")) * p_j, ["mu"])
    table = cut(table)
    all_sums = cut(sums(classes.select(F.col("c").alias("id"), "mu")).select("mu", "d", "s", "m"))
    found = None
    for i, name in enumerate(names):
        key = seed if same_seed or i == 0 else f"{seed}/{i}"
        each = focal.select("id", "mu", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
        each = spread(each).withColumn("u", E.hash_uniform(key, F.col("id"), F.col("rep"), F.col("r")))
        got = drawn(each, table, k, ["mu"])
        value = _square_values(got, classes, key, draws) if name == "quadrangle" else _path_values(got, classes, all_sums, name)
        mean = value.groupBy("id", "rep").agg((F.sum("value") / draws).alias(name))
        whole = focal.select("id", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("rep")) if found is None else found
        found = whole.join(mean, ["id", "rep"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return found.groupBy("id").agg(*[F.avg(n).alias(n) for n in names]) if average else found


def _path_values(got: DataFrame, classes: DataFrame, all_sums: DataFrame, name: str) -> DataFrame:
    """(id, rep, value) of each draw (id, mu, rep, mu_j, total), for all motifs but squares: worked out once for each pair of classes that is drawn."""
    p = E.probability(-(F.col("mu") + F.col("mu_j")))
    pairs = got.select("mu", "mu_j", "total").distinct()
    pairs = pairs.join(all_sums.select("mu", F.col("d").alias("d_i"), F.col("s").alias("s_i")), "mu").join(all_sums.select(F.col("mu").alias("mu_j"), F.col("d").alias("d_j"), F.col("s").alias("s_j"), F.col("m").alias("m_j")), "mu_j")
    if name in ("triangle", "qwedge", "qhead"):
        # nodes that neighbour both, which are neither of them
        ik, jk = E.probability(-(F.col("mu") + F.col("mu_k"))), E.probability(-(F.col("mu_j") + F.col("mu_k")))
        shared = spread(pairs).crossJoin(classes.select(F.col("mu").alias("mu_k"), "w")).groupBy("mu", "mu_j").agg(F.sum(F.col("w") * ik * jk).alias("all"))
        both = F.col("all") - p * (E.probability(-2 * F.col("mu")) + E.probability(-2 * F.col("mu_j")))
        pairs = pairs.join(shared, ["mu", "mu_j"]).withColumn("common", both)
    value = {
        "triangle": lambda: F.col("common") / 2,
        "twedge": lambda: F.col("d_i") - p,
        "thead": lambda: F.col("d_j") - p,
        "qwedge": lambda: (F.col("d_j") - p) * (F.col("d_i") - p) - F.col("common"),
        # over k other than i and j: p_jk (d_k - p_ik - p_jk)
        "qhead": lambda: F.col("m_j") - p * F.col("d_i") - F.col("common") - (F.col("s_j") - p * p),
    }[name]()
    worth = pairs.select("mu", "mu_j", (F.col("total") * value).alias("value"))
    return got.hint("merge").join(worth, ["mu", "mu_j"]).select("id", "rep", "value")


def _square_values(got: DataFrame, classes: DataFrame, key: object, draws: int) -> DataFrame:
    """(id, rep, value) of each draw j: opposite nodes k drawn from the open neighbours of j, and the sum over the fourth node for each."""
    ij, ik, jk = (E.probability(-(F.col(a) + F.col(b))) for a, b in (("mu", "mu_j"), ("mu", "mu_k"), ("mu_j", "mu_k")))
    pairs = got.select("mu", F.col("mu_j").alias("mu_1")).distinct()
    # neither node again; equal mu of other nodes stay
    others = F.col("w_j") - (F.col("mu_j") == F.col("mu")).cast("double") - (F.col("mu_j") == F.col("mu_1")).cast("double")
    weight = others * E.probability(-(F.col("mu_1") + F.col("mu_j"))) * (1 - E.probability(-(F.col("mu") + F.col("mu_j"))))
    table, k = guide(classes, pairs, weight, ["mu", "mu_1"])
    second = got.select("id", "rep", "r", "mu", F.col("mu_j").alias("mu_1"), F.col("total").alias("total_1"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("t"))
    second = second.withColumn("u", E.hash_uniform(key, F.col("id"), F.col("rep"), F.col("r"), F.col("t")))
    chosen = drawn(second, cut(table), k, ["mu", "mu_1"]).select("id", "rep", "mu", F.col("mu_1").alias("mu_j"), F.col("mu_j").alias("mu_k"), "total_1", "total")
    threes = chosen.select("mu", "mu_j", "mu_k").distinct()
    kl, il, jl = (E.probability(-(F.col(a) + F.col("mu_l"))) for a in ("mu_k", "mu", "mu_j"))
    all_ = spread(threes).crossJoin(classes.select(F.col("mu").alias("mu_l"), "w")).groupBy("mu", "mu_j", "mu_k").agg(F.sum(F.col("w") * kl * il * (1 - jl)).alias("last"))
    # the fourth node is none of the three: their own terms go
    ii, jj, kk = (E.probability(-2 * F.col(a)) for a in ("mu", "mu_j", "mu_k"))
    last = F.col("last") - ik * ii * (1 - ij) - jk * ij * (1 - jj) - kk * ik * (1 - jk)
    worth = all_.select("mu", "mu_j", "mu_k", last.alias("last"))
    return chosen.hint("merge").join(worth, ["mu", "mu_j", "mu_k"]).select("id", "rep", (F.col("total_1") * F.col("total") * F.col("last") / 2 / draws).alias("value"))


def _uniforms(key: object, ids: list, tails: list[str]) -> np.ndarray:
    """hash_uniform of the key, each id and each tail: a row for each id."""
    texts, ends = np.array([str(i) for i in ids], dtype="S"), np.array(tails, dtype="S")
    long, wide = np.char.str_len(texts), np.char.str_len(ends)
    keys, places = digests.Keys(len(ids) * len(tails)), np.arange(len(ids) * len(tails)).reshape(len(ids), -1)
    for a in np.unique(long):
        rows = np.flatnonzero(long == a)
        words = digests.text_words(texts[rows].astype(f"S{a}"))
        for b in np.unique(wide):
            cols = np.flatnonzero(wide == b)
            last = digests.text_words(ends[cols].astype(f"S{b}"))
            first = [np.repeat(x, len(cols)) for x in words.T]
            keys.add([f"{key}:".encode(), (first, int(a)), b":", ([np.tile(x, len(rows)) for x in last.T], int(b))], places[np.ix_(rows, cols)].ravel())
    return keys.uniforms().reshape(len(ids), -1)


class _Class:
    """What draws of the nodes of one class are worth; classes: mu, w and, where a motif needs them, d, s and m, in order of mu."""

    def __init__(self, classes: dict[str, np.ndarray], whole: np.ndarray | None, at: int):
        self.mu, self.w, self.at, self.whole = classes["mu"], classes["w"], at, whole
        self.d, self.s, self.m = (classes.get(k) for k in ("d", "s", "m"))
        self.p = self.rows(np.array([at]))[0]
        self.own = _sigmoid(2 * self.mu)
        self.total, self.edges = self.line((self.w - (np.arange(len(self.mu)) == at)) * self.p)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of these classes with all."""
        return self.whole[at] if self.whole is not None else _sigmoid(self.mu[at][:, None] + self.mu)

    @staticmethod
    def line(weight: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of weights, and where on the line from 0 to 1 each one's part ends."""
        upto = np.cumsum(np.maximum(weight, 0))
        return float(upto[-1]), upto / upto[-1] if upto[-1] > 0 else upto

    def summed(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each of these classes the sum over all of its probability times x."""
        return np.concatenate([self.rows(at[k : k + ROWS]) @ x for k in range(0, len(at), ROWS)])

    def path(self, name: str, b: np.ndarray) -> np.ndarray:
        """What neighbours of classes b are worth, for all motifs but squares."""
        p, i = self.p[b], self.at
        if name == "twedge":
            return self.d[i] - p
        if name == "thead":
            return self.d[b] - p
        common = self.summed(b, self.w * self.p) - p * (self.own[i] + self.own[b])
        if name == "triangle":
            return common / 2
        if name == "qwedge":
            return (self.d[b] - p) * (self.d[i] - p) - common
        return self.m[b] - p * self.d[i] - common - (self.s[b] - p * p)

    def squares(self, j: int, u: np.ndarray) -> np.ndarray:
        """What draws of a neighbour of class j are worth, the sum over the opposite nodes that u, a row for each, falls on."""
        of_j, places = self.rows(np.array([j]))[0], np.arange(len(self.mu))
        total, edges = self.line((self.w - (places == self.at) - (places == j)) * of_j * (1 - self.p))
        if total <= 0:
            return np.zeros(len(u))
        k, back = np.unique(np.searchsorted(edges, u, side="right"), return_inverse=True)
        ij, ik, jk = self.p[j], self.p[k], of_j[k]
        last = self.summed(k, self.w * self.p * (1 - of_j))
        last = last - ik * self.own[self.at] * (1 - ij) - jk * ij * (1 - self.own[j]) - self.own[k] * ik * (1 - jk)
        return total * last[back.reshape(u.shape)].sum(1) / 2 / u.shape[1]

    def values(self, name: str, u: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        """What each draw is worth; second: of each draw the numbers for opposite nodes."""
        if self.total <= 0:
            return np.zeros(u.shape)
        b, back = np.unique(np.searchsorted(self.edges, u, side="right"), return_inverse=True)
        back = back.reshape(u.shape)
        if name != "quadrangle":
            return self.total * self.path(name, b)[back]
        out, order = np.empty(u.size), np.argsort(back, axis=None, kind="stable")
        ends = np.searchsorted(back.ravel()[order], np.arange(len(b) + 1))
        for n, j in enumerate(b.tolist()):
            own = order[ends[n] : ends[n + 1]]
            out[own] = self.total * self.squares(j, second[own])
        return out.reshape(u.shape)


def _drawn_in_tasks(classes: DataFrame, focal: DataFrame, names: tuple[str, ...], draws: int, seed: int, repeat: int, average: bool, same_seed: bool, sums: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """monte_carlo() where each task has all classes: nodes are dealt out in order of mu, so that a task meets few classes, and large ones are several tasks'."""
    spark = focal.sparkSession
    known = classes.select("c", "mu", "w")
    if {"twedge", "thead", "qwedge", "qhead"} & set(names):
        known = known.join(sums(classes.select(F.col("c").alias("id"), "mu")).select(F.col("id").alias("c"), "d", "s", "m"), "c")
    table = known.orderBy("c").toPandas()
    shared = spark.sparkContext.broadcast({k: table[k].to_numpy(dtype="float64") for k in table.columns if k != "c"})
    names, seeds = tuple(names), [seed if same_seed or i == 0 else f"{seed}/{i}" for i in range(len(names))]
    tails = [f"{rep}:{r}" for rep in range(repeat) for r in range(draws)]
    deeper = [f"{x}:{t}" for x in tails for t in range(draws)]
    step = max(1, AT_ONCE // len(deeper if "quadrangle" in names else tails))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        whole = _sigmoid(known["mu"][:, None] + known["mu"]) if len(known["mu"]) <= WHOLE else None
        one = None
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids, at = part.column(0).to_pylist(), np.searchsorted(known["mu"], part.column(1).to_numpy())
                u = {k: _uniforms(k, ids, tails) for k in dict.fromkeys(seeds)}
                second = {k: _uniforms(k, ids, deeper).reshape(len(ids), len(tails), draws) for k, name in zip(seeds, names, strict=True) if name == "quadrangle"}
                found = np.empty((len(names), len(ids), repeat))
                for c in np.unique(at):
                    own = np.flatnonzero(at == c)
                    one = one if one is not None and one.at == c else _Class(known, whole, int(c))
                    for n, (name, k) in enumerate(zip(names, seeds, strict=True)):
                        of_squares = second[k][own].reshape(-1, draws) if name == "quadrangle" else None
                        found[n, own] = one.values(name, u[k][own], of_squares).reshape(len(own), repeat, draws).sum(2) / draws
                if average:
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x.mean(1)) for x in found]], names=["id", *names])
                else:
                    each, reps = np.repeat(np.arange(len(ids)), repeat), np.tile(np.arange(repeat, dtype=np.int32), len(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(each)), pa.array(reps), *[pa.array(x.ravel()) for x in found]], names=["id", "rep", *names])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = focal.select("id", "mu").repartitionByRange(parts, "mu", "id").sortWithinPartitions("mu")
    kind = focal.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *([] if average else ["rep int"]), *[f"{k} double" for k in names]]))
