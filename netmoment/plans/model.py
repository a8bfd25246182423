"""The ensemble model: undirected, unweighted random graphs with independent edges."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.checkpoints import numbered


def spread(rows: DataFrame) -> DataFrame:
    """Rows that each meet all others, dealt out over all cores: a table of few bytes is work for many.

    Of a cross join both sides are, since the smaller one by the planner's estimate is broadcast and the other one's tasks do the work.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


@dataclass(frozen=True)
class Ensemble:
    """n nodes; either one mu for all (homogeneous: p = sigmoid(mu)) or nodes(id, mu) (p_ij = sigmoid(mu_i + mu_j))."""

    spark: SparkSession
    n: int
    mu: float | None = None
    table: DataFrame | None = None

    @classmethod
    def homogeneous(cls, spark: SparkSession, n: int, mu: float = 0.0) -> Ensemble:
        if n <= 0:
            raise ValueError("n must be positive")
        return cls(spark, n, float(mu))

    @classmethod
    def heterogeneous(cls, nodes: DataFrame, check: bool = True) -> Ensemble:
        """Of nodes(id, mu): unique ids that are not null, and numbers as mu."""
        n, ids, bad = nodes.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(F.col("mu").isNull() | F.isnan("mu"))).first()
        if check and (not n or n != ids or bad):
            raise ValueError(f"nodes must be one or more, with unique ids and a number as mu: {n} rows, {ids} ids, {bad} without mu")
        return cls(nodes.sparkSession, n, None, nodes.select("id", "mu"))

    @property
    def is_homogeneous(self) -> bool:
        return self.mu is not None

    @property
    def p(self) -> float:
        """The edge probability of a homogeneous model."""
        return 1 / (1 + math.exp(-self.mu)) if self.mu > -700 else 0.0

    def replace(self, **changes) -> Ensemble:
        return replace(self, **changes)

    @property
    def all_nodes(self) -> DataFrame:
        """(id, mu); for a homogeneous model ids 0 to n-1."""
        return self.table if self.table is not None else self.spark.range(self.n).select("id", F.lit(self.mu).alias("mu"))

    @property
    def nodes(self) -> NodeView:
        return NodeView(self)

    @property
    def pairs(self) -> PairView:
        return PairView(self)

    def classes(self, digits: int | None = None) -> DataFrame:
        """(mu, w): distinct parameters and how many nodes have them; digits merges parameters that round alike."""
        mu = F.col("mu") if digits is None else F.round("mu", digits)
        return self.all_nodes.groupBy(mu.alias("mu")).agg(F.count(F.lit(1)).alias("w"))

    def merged(self, step: float) -> Ensemble:
        """The model with parameters rounded down to multiples of step, so that it has few classes."""
        if step <= 0:
            raise ValueError("the step must be positive")
        return self if self.is_homogeneous else replace(self, table=self.table.withColumn("mu", F.floor(F.col("mu") / step) * step))

    def pair_mu(self, a: str, b: str) -> Column:
        return F.lit(self.mu) if self.is_homogeneous else F.col(a) + F.col(b)


#: Nodes drawn without replacement up to which the first ones of all tasks meet in one.
FEW_DRAWN = 10_000
Index = "int | list[int] | slice | Column | None"


@dataclass(frozen=True)
class NodeView:
    """A selection of nodes, in order and with repetitions: an id, a list, a slice of ids or a condition on id and mu."""

    model: Ensemble
    index: object = None

    def __getitem__(self, index) -> NodeView:
        if self.index is not None:
            raise IndexError("the view is a selection already; reset() it first")
        if isinstance(index, tuple):
            if len(index) != 1:
                raise ValueError(f"too many indices: expected 1, got {len(index)}")
            index = index[0]
        return NodeView(self.model, slice(None) if index is Ellipsis else index)

    def reset(self) -> NodeView:
        return NodeView(self.model)

    @property
    def is_active(self) -> bool:
        return self.index is not None

    def rows(self) -> DataFrame:
        """(pos, id, mu)."""
        return _selected(self.model, self.index)

    def focal(self) -> DataFrame:
        """(id, mu), each once."""
        return self.rows().select("id", "mu").distinct() if self.is_active else self.model.all_nodes

    def coords(self) -> DataFrame:
        return self.rows().select("pos", "id")

    def size(self) -> int:
        return self.rows().count() if self.is_active else self.model.n

    @property
    def ndim(self) -> int:
        """0 for one node, else 1."""
        return 0 if isinstance(self.index, int) else 1

    def shape(self) -> tuple[int, ...]:
        return () if self.ndim == 0 else (self.size(),)

    def unique(self) -> DataFrame:
        """(id): the selected nodes, each once."""
        return self.focal().select("id")

    def induced_pairs(self) -> PairView:
        """All pairs of the selected nodes."""
        return PairView(self.model, (self.index, self.index), "outer")

    def parameter(self) -> DataFrame:
        return self.rows().select("pos", "id", "mu")

    def materialize(self) -> Ensemble:
        """The induced model on the distinct selected nodes, ids renumbered from 0 in order."""
        if not self.is_active:
            return self.model
        ids = self.focal()
        if self.model.is_homogeneous:
            return Ensemble.homogeneous(self.model.spark, ids.count(), self.model.mu)
        return Ensemble.heterogeneous(numbered(ids, "at", "id").select(F.col("at").alias("id"), "mu"))

    def sample(self, n: int, seed: int = 0, replace: bool = False) -> DataFrame:
        """(pos, id, mu) of n random nodes of the view, the same for the same seed."""
        rows = self.rows()
        if not replace:
            rows = rows.withColumn("u", E.hash_uniform(seed, F.col("id"), F.col("pos")))
            if n > FEW_DRAWN:
                return numbered(rows, "at", "u", "pos").where(F.col("at") < n).select(F.col("at").alias("pos"), "id", "mu")
            first = rows.orderBy("u", "pos").limit(n)  # as many rows as are asked for
            return first.select((F.row_number().over(Window.orderBy("u", "pos")) - 1).cast("long").alias("pos"), "id", "mu")
        size = self.size()
        draws = self.model.spark.range(n).select(F.col("id").alias("pos"), F.floor(E.hash_uniform(seed, F.col("id")) * size).alias("at"))
        placed = rows.select(F.col("pos").alias("at"), "id", "mu") if self.is_active else numbered(rows.select("id", "mu"), "at", "id")
        return draws.join(placed, "at").select("pos", "id", "mu")


def _selected(model: Ensemble, index) -> DataFrame:
    base = model.all_nodes
    if index is None:
        return base.select(F.col("id").alias("pos"), "id", "mu")
    if isinstance(index, Column):
        return base.where(index).select(F.col("id").alias("pos"), "id", "mu")
    if isinstance(index, slice):
        start, stop, step = index.start, index.stop, 1 if index.step is None else index.step
        if step == 0:
            raise ValueError("a slice's step must not be 0")
        ends = base.agg(F.min("id").alias("lo"), (F.max("id") + 1).alias("hi"))
        at = lambda x: F.lit(x) if x >= 0 else F.col("hi") + x
        rows = base.crossJoin(F.broadcast(ends))
        if step < 0:  # from the last id down, positions in that order
            first = F.least(F.col("hi") - 1, F.col("hi") - 1 if start is None else at(start))
            stop_at = F.col("lo") - 1 if stop is None else at(stop)
            found = rows.where((F.col("id") <= first) & (F.col("id") > stop_at) & ((first - F.col("id")) % -step == 0))
            return found.select(((first - F.col("id")) / -step).cast("long").alias("pos"), "id", "mu")
        lo = F.col("lo") if start is None else at(start)
        hi = F.col("hi") if stop is None else at(stop)
        found = rows.where((F.col("id") >= lo) & (F.col("id") < hi) & ((F.col("id") - lo) % step == 0))
        return found.select(F.col("id").alias("pos"), "id", "mu")
    ids = [index] if isinstance(index, int) else [int(i) for i in index]
    taken = model.spark.createDataFrame(list(enumerate(ids)), "pos long, id long").join(base, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no such node: "), F.col("id").cast("string"))).cast("double")
    return taken.select("pos", "id", F.when(F.col("mu").isNull(), missing).otherwise(F.col("mu")).alias("mu"))


@dataclass(frozen=True)
class PairView:
    """Ordered pairs: all, a row [i], pointwise [i, j], or outer(i, j)."""

    model: Ensemble
    index: tuple | None = None
    kind: str = "outer"

    def __getitem__(self, index) -> PairView:
        if self.index is not None:
            raise IndexError("the view is a selection already; reset() it first")
        index = index if isinstance(index, tuple) else (index,)
        if len(index) > 2:
            raise ValueError(f"too many indices: expected 2, got {len(index)}")
        points = len(index) == 2 and all(isinstance(k, (int, list)) for k in index)
        return PairView(self.model, (*index, None)[:2], "pointwise" if points else "outer")

    def outer(self, i, j) -> PairView:
        return PairView(self.model, (i, j), "outer")

    def reset(self) -> PairView:
        return PairView(self.model)

    def rows(self) -> DataFrame:
        """(i, j, coupling), with pos_i and pos_j in the order of the selection."""
        at = self.index or (None, None)
        a, b = (_selected(self.model, None if k is Ellipsis else k) for k in at)
        a = a.select(F.col("pos").alias("pos_i"), F.col("id").alias("i"), F.col("mu").alias("mu_i"))
        b = b.select(F.col("pos").alias("pos_j"), F.col("id").alias("j"), F.col("mu").alias("mu_j"))
        if self.kind == "pointwise":
            one_i, one_j = (isinstance(k, int) for k in at)
            both = a.crossJoin(b) if one_i or one_j else a.join(b, F.col("pos_i") == F.col("pos_j"))
        else:
            both = spread(a).crossJoin(spread(b))
        return both.select("pos_i", "pos_j", "i", "j", E.coupling(self.model.pair_mu("mu_i", "mu_j"), F.col("i"), F.col("j")).alias("coupling"))

    @property
    def is_active(self) -> bool:
        return self.index is not None

    def shape(self) -> tuple[int, ...]:
        """Of the selection's positions: one axis for pointwise lists, else an axis for each index that is no single node."""
        sides = [NodeView(self.model, None if k is Ellipsis else k) for k in self.index or (None, None)]
        if self.kind == "pointwise":
            return max((x.shape() for x in sides), key=len)
        return tuple(n for x in sides for n in x.shape())

    def size(self) -> int:
        return math.prod(self.shape())

    def unique(self) -> DataFrame:
        """(i, j): the selected pairs, each once."""
        return self.rows().select("i", "j").distinct()

    def nodes(self) -> DataFrame:
        """(id) of the nodes that the pairs touch."""
        r = self.rows()
        return r.select(F.col("i").alias("id")).union(r.select(F.col("j").alias("id"))).distinct()

    def couplings(self) -> DataFrame:
        return self.rows()

    def probs(self, log: bool = False) -> DataFrame:
        c = F.col("coupling")
        return self.rows().select("pos_i", "pos_j", "i", "j", (E.log_probability(c) if log else E.probability(c)).alias("p"))

    def free_energy(self) -> DataFrame:
        return self.rows().select("pos_i", "pos_j", "i", "j", E.edge_free_energy(F.col("coupling")).alias("fe"))
