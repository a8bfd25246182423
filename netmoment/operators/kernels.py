"""Block kernels for the sums that joins would make cubic: numpy over broadcast parameters.

A task takes focal nodes and computes their rows against all nodes by matrix
products.  The broadcast holds a few numbers for each node: id, mu, and the sums of its row that a motif needs, which come from
distributed plans.  A task holds one row of the matrix for a focal node and blocks of COLUMNS columns of others.  Exact sums need at
least n**2 operations for each focal node, so they are refused beyond
options' exact_nodes; Monte Carlo, whose draws and sums look at few points in place of all nodes where there are many (see lines), beyond mc_nodes, with which the broadcast stays below
128 MB.  Both bounds can be raised by the caller.

Random numbers are those of functions.expr.hash_uniform of the seed, the node, the repetition and the draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import options
from ..plans.model import Ensemble
from . import lines

#: Focal nodes in a block, and columns that are made at once.
ROWS, COLUMNS = 64, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _parameters(model: Ensemble, most: int, sums: DataFrame | None = None) -> dict[str, np.ndarray]:
    """id, mu and, with sums(id, d[, s, m]) of all nodes, these, in order of id; a copy for each worker."""
    if model.n > most:
        raise ValueError(f"{model.n} nodes are more than this kernel takes ({most})")
    t = (model.all_nodes if sums is None else sums).orderBy("id").toPandas()
    return {c: t[c].to_numpy() for c in t.columns}


def _rows(mu: np.ndarray, at: np.ndarray) -> np.ndarray:
    """p of the nodes at places at against all."""
    p = _sigmoid(mu[at][:, None] + mu[None])
    p[np.arange(len(at)), at] = 0
    return p


def _squared(mu: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p @ P for the whole probability matrix P, made in blocks of columns."""
    out = np.empty_like(p)
    for a in range(0, len(mu), COLUMNS):
        cols = np.arange(a, min(a + COLUMNS, len(mu)))
        out[:, cols] = p @ _rows(mu, cols).T
    return out


def _quadrangle(mu: np.ndarray, p: np.ndarray, whole: np.ndarray | None, i: int, at: int) -> float:
    """Chordless squares at the node in row i of p: sum over opposite nodes k of open pairs of neighbours that they share."""
    row = p[i]
    total = 0.0
    for a in range(0, len(mu), COLUMNS):
        cols = np.arange(a, min(a + COLUMNS, len(mu)))
        block = (whole[cols] if whole is not None else _rows(mu, cols)).T  # P_jk for k in cols
        x = row[:, None] * block
        inner = (whole @ x) if whole is not None else np.vstack([_rows(mu, np.arange(b, min(b + COLUMNS, len(mu)))) @ x for b in range(0, len(mu), COLUMNS)])
        pairs = x.sum(0) ** 2 - (x * x).sum(0) - (x * inner).sum(0)
        open_ = 1 - row[cols]
        open_[cols == at] = 0
        total += float(open_ @ pairs)
    return total / 2


def exact(model: Ensemble, focal: DataFrame, names: list[str], sums: DataFrame | None) -> DataFrame:
    """(id, names) of focal nodes, for names among triangle, quadrangle, qwedge, qhead; sums: (id, mu, d, s, m) of all nodes, for the last two."""
    shared = model.spark.sparkContext.broadcast(_parameters(model, options.get("exact_nodes"), sums))
    names = list(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t_ = shared.value
        ids, mu, d, s, m = (t_.get(k) for k in ("id", "mu", "d", "s", "m"))
        n = len(mu)
        whole = _rows(mu, np.arange(n)) if n <= COLUMNS and (not {"triangle"} >= set(names)) else None
        for part in parts:
            for a in range(0, len(part), ROWS):
                own = part["id"].to_numpy()[a : a + ROWS]
                at = np.searchsorted(ids, own)
                p = _rows(mu, at)
                t = (p * (p @ whole if whole is not None else _squared(mu, p))).sum(1) / 2 if set(names) != {"quadrangle"} else None
                out = {"id": own}
                for k in names:
                    if k == "triangle":
                        out[k] = t
                    elif k == "quadrangle":
                        out[k] = [_quadrangle(mu, p, whole, i, x) for i, x in enumerate(at)]
                    elif k == "qwedge":
                        out[k] = (p * (d[at][:, None] - p) * (d[None] - p)).sum(1) - 2 * t
                    else:
                        out[k] = (p * (m[None] - p * d[at][:, None] - s[None] + p * p)).sum(1) - 2 * t
                yield pd.DataFrame(out)

    parts = max(1, min(focal.sparkSession.sparkContext.defaultParallelism * 4, -(-model.n // ROWS)))
    return focal.select("id").repartition(parts, "id").mapInPandas(run, ", ".join(["id long", *[f"{k} double" for k in names]]))


def uniform(*parts: object) -> float:
    """hash_uniform of plain values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def _drawn(weights: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of weights, and for each number the place whose part of the line from 0 to 1 it falls into."""
    upto = np.cumsum(weights)
    return float(upto[-1]), np.minimum(np.searchsorted(upto, u * upto[-1], side="right"), len(weights) - 1)


class _Draws:
    """A focal node's random neighbours, the same for all its motifs; d: the degrees of all nodes, where a motif needs them."""

    def __init__(self, mu: np.ndarray, d: np.ndarray | None, at: int, draws: int, key: tuple):
        self.mu, self.d, self.at, self.draws, self.key = mu, d, at, draws, key
        self.p = _rows(mu, np.array([at]))[0]
        self.weight, self.j = _drawn(self.p, np.array([uniform(*key, r) for r in range(draws)]))
        self.p_j = self.p[self.j]
        self.sums: dict[str, np.ndarray] = {}

    def mean(self, values: np.ndarray) -> float:
        return self.weight * float(values.mean()) if self.weight > 0 else 0.0

    def summed(self, name: str, values: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
        """For each neighbour j the sum over k other than i of values(p_jk, k), in blocks of k."""
        if name not in self.sums:
            total = np.zeros(self.draws)
            for a in range(0, len(self.mu), COLUMNS):
                k = slice(a, min(a + COLUMNS, len(self.mu)))
                block = _sigmoid(self.mu[self.j][:, None] + self.mu[None, k])
                for at in (self.j, np.full(self.draws, self.at)):
                    inside = np.flatnonzero((at >= a) & (at < a + COLUMNS))
                    block[inside, at[inside] - a] = 0
                total += values(block, k).sum(1)
            self.sums[name] = total
        return self.sums[name]

    def common(self) -> np.ndarray:
        return self.summed("common", lambda pj, k: pj * self.p[k])

    def triangle(self) -> float:
        return self.mean(self.common()) / 2

    def twedge(self) -> float:
        return self.mean(self.d[self.at] - self.p_j)

    def thead(self) -> float:
        return self.mean(self.d[self.j] - self.p_j)

    def qwedge(self) -> float:
        return self.mean((self.d[self.j] - self.p_j) * (self.d[self.at] - self.p_j) - self.common())

    def qhead(self) -> float:
        return self.mean(self.summed("paths", lambda pj, k: pj * (self.d[k] - self.p[k] - pj)))

    def quadrangle(self) -> float:
        p, total = self.p, 0.0
        for r, j in enumerate(self.j):
            row = _rows(self.mu, np.array([j]))[0]
            row[self.at] = 0
            edge, k = _drawn(row * (1 - p), np.array([uniform(*self.key, r, s) for s in range(self.draws)]))
            if edge <= 0:
                continue
            last = p * (1 - row)
            last[j] = 0
            found = 0.0
            for a in range(0, len(p), COLUMNS):
                block = _sigmoid(self.mu[k][:, None] + self.mu[None, a : a + COLUMNS])
                inside = np.flatnonzero((k >= a) & (k < a + COLUMNS))
                block[inside, k[inside] - a] = 0
                found += float((block @ last[a : a + COLUMNS]).mean())
            total += edge * found / 2
        return self.weight * total / self.draws


class _LineDraws(_Draws):
    """The same of many nodes, for which a line's points stand."""

    def __init__(self, line: lines.Line, d: np.ndarray | None, at: int, draws: int, key: tuple):
        self.line, self.mu, self.d, self.at, self.draws, self.key = line, line.mu, d, at, draws, key
        own = self.mu[at]
        self.weight, self.j, self.p_j = line.drawn(lambda x: lines.sigmoid(own + x), [at], np.array([uniform(*key, r) for r in range(draws)]))
        #: p of the points with the focal node and with its neighbours; of the focal node and of each neighbour with itself.
        self.p, self.of_j = lines.sigmoid(own + line.x), lines.sigmoid(self.mu[self.j][:, None] + line.x)
        self.own, self.own_j = float(lines.sigmoid(2 * own)), lines.sigmoid(2 * self.mu[self.j])
        self.sums = {}

    def common(self) -> np.ndarray:
        if "common" not in self.sums:
            self.sums["common"] = (self.of_j * self.p) @ self.line.whole - self.p_j * (self.own + self.own_j)
        return self.sums["common"]

    def qhead(self) -> float:
        both = (self.of_j * self.p) @ self.line.whole
        paths = self.of_j @ self.line.heads - both - (self.of_j * self.of_j) @ self.line.whole
        at_i = self.p_j * (self.d[self.at] - self.own - self.p_j)
        at_j = self.own_j * (self.d[self.j] - self.p_j - self.own_j)
        return self.mean(paths - at_i - at_j)

    def quadrangle(self) -> float:
        own, total = self.mu[self.at], 0.0
        for r, j in enumerate(self.j.tolist()):
            of_j = self.mu[j]
            edge, k, _ = self.line.drawn(lambda x, a=of_j: lines.sigmoid(a + x) * lines.sigmoid(-own - x), [self.at, j], np.array([uniform(*self.key, r, s) for s in range(self.draws)]))
            if edge <= 0:
                continue
            mu = self.mu[k]
            f = lambda x, a=of_j, mu=mu: lines.sigmoid(mu[:, None] + x) * (lines.sigmoid(own + x) * lines.sigmoid(-a - x))
            coinciding = f(np.array([own, of_j])).sum(1) + lines.sigmoid(2 * mu) * lines.sigmoid(own + mu) * lines.sigmoid(-of_j - mu)
            total += edge * float((f(self.line.x) @ self.line.whole - coinciding).mean()) / 2
        return self.weight * total / self.draws


#: Motifs that need the degrees of all nodes.
OF_DEGREES = frozenset(("twedge", "thead", "qwedge", "qhead"))


def monte_carlo(model: Ensemble, focal: DataFrame, names: tuple[str, ...], draws: int, seed: int = 0, repeat: int | None = None, average: bool = True, same_seed: bool = True, degrees: DataFrame | None = None) -> DataFrame:
    """(id[, rep], names): importance-sampling estimates; neighbours are drawn in proportion to the edge probabilities.

    A node's draws depend on seed, its id and the repetition only.  Without average there is a row for each repetition;
    with same_seed the motifs share their draws.  degrees: (id, mu, d) of all nodes, for motifs of OF_DEGREES.
    """
    repeat = options.get("mc_repeat") if repeat is None else repeat
    if draws <= 0 or repeat <= 0:
        raise ValueError("draws and repetitions must be positive")
    table = _parameters(model, options.get("mc_nodes"), degrees)
    pieces = lines.pieces_of(float(table["mu"].min()), float(table["mu"].max()), model.n)
    shared = model.spark.sparkContext.broadcast(table)
    names = tuple(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mu, d = (shared.value.get(k) for k in ("id", "mu", "d"))
        line = lines.Line(mu, pieces, d) if pieces else None
        start = lambda at, key: _LineDraws(line, d, at, draws, key) if line else _Draws(mu, d, at, draws, key)
        for part in parts:
            rows = []
            for i in part["id"]:
                at = int(np.searchsorted(ids, i))
                for r in range(repeat):
                    one = start(at, (seed, int(i), r))
                    each = [one] * len(names) if same_seed else [one, *(start(at, (f"{seed}/{k}", int(i), r)) for k in range(1, len(names)))]
                    rows.append((int(i), r, *(getattr(x, k)() for x, k in zip(each, names, strict=True))))
            yield pd.DataFrame(rows, columns=["id", "rep", *names])

    parts = max(1, min(focal.sparkSession.sparkContext.defaultParallelism * 4, -(-model.n // 8)))
    found = focal.select("id").repartition(parts, "id").mapInPandas(run, ", ".join(["id long, rep int", *[f"{k} double" for k in names]]))
    return found.groupBy("id").agg(*[F.avg(k).alias(k) for k in names]) if average else found
