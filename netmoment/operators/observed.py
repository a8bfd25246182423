"""Statistics of observed graphs: nodes(id) and canonical edges(src, dst).

Counts of open and closed paths come from degrees and sums over neighbours;
triangles from wedges centred on their lowest node in the order of (degree, id),
which bounds a hub's wedges by the square root of the number of edges.
Dense graphs, which have too many paths to list, are counted on bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from ..sources.graphs import both_ways
from . import bitmaps
from .stats import COEFFICIENTS, coefficient_columns

CENSUS = ("t", "tw", "th", "q0", "qw", "qh")
_OF_MOTIF = {"triangle": "t", "twedge": "tw", "thead": "th", "quadrangle": "q0", "qwedge": "qw", "qhead": "qh"}


def degree(ids: DataFrame, edges: DataFrame, normalize: bool = False) -> DataFrame:
    """(id, degree) of all nodes, isolated ones included."""
    k = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))  # edges are worked out once
    found = ids.select("id").join(k, "id", "left").select("id", F.coalesce("k", F.lit(0)).cast("long").alias("degree"))
    if not normalize:
        return found
    return found.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n")))).select("id", (F.col("degree") / F.col("n")).alias("degree"))


def edge_count(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row (edge_count); with ids for each of them, as the normalized count is."""
    count = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    if ids is None:
        return count
    return count.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n")))).select(F.try_divide("edge_count", "n").alias("edge_count"))


def density(ids: DataFrame, edges: DataFrame) -> DataFrame:
    n = ids.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return edge_count(edges).crossJoin(F.broadcast(n)).select(F.try_divide(2 * F.col("edge_count"), F.col("n") * (F.col("n") - 1)).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle once."""
    k = both_ways(edges).groupBy("i").agg(F.count(F.lit(1)).alias("k"))
    ends = edges.join(k.select(F.col("i").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("i").alias("dst"), F.col("k").alias("kd")), "dst")
    first = F.struct("ks", "src") < F.struct("kd", "dst")
    up = ends.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = up.select("u", F.col("v").alias("x")).join(up.select("u", F.col("v").alias("y")), "u").where("x < y")
    return wedges.join(edges, (F.col("x") == F.col("src")) & (F.col("y") == F.col("dst"))).select(F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def census(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, t, tw, th, q0, qw, qh): triangles, 2-paths by centre and by end, chordless squares, 3-paths by second node and by end."""
    if (dense := bitmaps.pack(ids, edges)) is not None:
        return _dense_census(ids, dense, True)
    adj = both_ways(edges)
    k = degree(ids, edges)
    tri = triangles(edges)
    t = tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    near = adj.join(k.select(F.col("id").alias("j"), F.col("degree").alias("k_j")), "j").groupBy(F.col("i").alias("id")).agg(F.sum("k_j").alias("m"))
    base = k.join(t, "id", "left").join(near, "id", "left").na.fill(0, ["t", "m"])
    of_j = base.select(F.col("id").alias("j"), F.col("degree").alias("k_j"), F.col("m").alias("m_j"))
    sums = adj.join(of_j, "j").groupBy(F.col("i").alias("id")).agg(F.sum("m_j").alias("mm"), F.sum("k_j").alias("kk"))
    squares = chordless_squares(edges, tri)
    all_ = base.join(sums, "id", "left").join(squares, "id", "left").na.fill(0, ["mm", "kk", "q0"])
    d = F.col("degree")
    return all_.select(
        "id", "t", (d * (d - 1)).alias("tw"), (F.col("kk") - d).alias("th"), F.col("q0").cast("long").alias("q0"),
        ((d - 1) * (F.col("kk") - d) - 2 * F.col("t")).alias("qw"),
        (F.col("mm") - d * d - F.col("kk") + d - 2 * F.col("t")).alias("qh"),
    )


def _dense_census(ids: DataFrame, g: bitmaps.Bitmaps, squares: bool) -> DataFrame:
    """census() of a dense graph; without squares only t, tw and th."""
    found = ids.select("id").join(g.degrees().join(bitmaps.squares(g) if squares else bitmaps.paths(g), "id"), "id")
    d, t = F.col("degree"), (F.col("t2") / 2).cast("long")
    three = [t.alias("t"), (d * (d - 1)).alias("tw"), (F.col("m") - d).alias("th")]
    four = [F.col("q0"), ((d - 1) * (F.col("m") - d) - 2 * t).alias("qw"), (F.col("mm") - d * d - F.col("m") + d - 2 * t).alias("qh")]
    return found.select("id", *three, *(four if squares else []))


def chordless_squares(edges: DataFrame, tri: DataFrame) -> DataFrame:
    """(id, q0): for nodes i and k that are not adjacent, pairs of common neighbours less the adjacent pairs of them, by i.

    A square is counted once, at its last node in the order of (degree, id), for all four of its nodes: 2-paths are listed from there
    only, which bounds a hub's by its later neighbours, of which there are at most about the square root of twice the edges.
    """
    adj = both_ways(edges)
    k = adj.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    rank = F.struct("k", "id")
    ranked = adj.join(k.select(F.col("id").alias("i"), rank.alias("ri")), "i").join(k.select(F.col("id").alias("j"), rank.alias("rj")), "j")
    # from the last node z of a square to its two neighbours x and y, and from these to the opposite node w
    to_x = ranked.where(F.col("rj") < F.col("ri")).select(F.col("i").alias("z"), F.col("ri").alias("rz"), F.col("j").alias("x"))
    paths = to_x.join(ranked.select(F.col("i").alias("x"), F.col("j").alias("w"), F.col("rj").alias("rw")), "x").where(F.col("rw") < F.col("rz")).select("z", "x", "w")
    open_ = paths.join(edges.select(F.col("src").alias("z"), F.col("dst").alias("w")).union(edges.select(F.col("dst").alias("z"), F.col("src").alias("w"))), ["z", "w"], "left_anti")
    # x and y of a square without the chord z-w, less those with the chord x-y
    ends = open_.groupBy("z", "w").agg(F.count(F.lit(1)).alias("c"))
    of_ends = ends.select(F.explode(F.array("z", "w")).alias("id"), (F.col("c") * (F.col("c") - 1) / 2).alias("q"))
    of_middles = open_.join(ends, ["z", "w"]).select(F.col("x").alias("id"), (F.col("c") - 1).cast("double").alias("q"))
    # squares with the one chord x-y have been counted if z or w is the last node: two triangles on an edge, whose third nodes are not adjacent
    on_edge = tri.select(F.explode(F.array(
        F.struct(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("c").alias("i")),
        F.struct(F.least("a", "c").alias("x"), F.greatest("a", "c").alias("y"), F.col("b").alias("i")),
        F.struct(F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"), F.col("a").alias("i")),
    )).alias("e")).select("e.x", "e.y", "e.i")
    of = lambda c: k.select(F.col("id").alias(c), rank.alias(f"r{c}"))
    on_edge = on_edge.join(of("x"), "x").join(of("y"), "y").join(of("i"), "i").select("x", "y", "i", (F.col("ri") > F.greatest("rx", "ry")).alias("last"))
    chord = on_edge.join(on_edge.select("x", "y", F.col("i").alias("k"), F.col("last").alias("other")), ["x", "y"]).where("i < k and (last or other)")
    chord = chord.join(edges.select(F.col("src").alias("i"), F.col("dst").alias("k")), ["i", "k"], "left_anti")
    less = chord.select(F.explode(F.array("i", "k", "x", "y")).alias("id"), F.lit(-1.0).alias("q"))
    return of_ends.union(of_middles).union(less).groupBy("id").agg(F.sum("q").alias("q0"))


def coefficients(ids: DataFrame, edges: DataFrame, names: tuple[str, ...] = tuple(COEFFICIENTS)) -> DataFrame:
    """(id, names): ratios of the census; those of triangles alone don't need its squares."""
    dense = bitmaps.pack(ids, edges) if all(COEFFICIENTS[k][0] == "triangle" for k in names) else None
    counts = census(ids, edges) if dense is None else _dense_census(ids, dense, False)
    counts = counts.select("id", *[F.col(c).alias(k) for k, c in _OF_MOTIF.items() if c in counts.columns])
    return counts.select("id", *coefficient_columns(names))


def global_coefficients(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: transitivity, similarity and complementarity of the whole graph, ratios of summed counts."""
    total = census(ids, edges).agg(*[F.sum(c).alias(k) for k, c in _OF_MOTIF.items()])
    return total.select(*coefficient_columns(tuple(COEFFICIENTS)))


def path_lengths(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, d): hop distances of connected ordered pairs, by rounds of joins until none is new.

    A neighbour of a node at distance d is at d - 1, d or d + 1, so a round looks at the last two rounds' pairs alone, and writes its own alone.
    """
    adj = cut(both_ways(edges))
    rounds = [cut(adj.select("i", "j", F.lit(1).alias("d")))]
    while rounds[-1].limit(1).count():
        d = len(rounds) + 1
        step = rounds[-1].select("i", F.col("j").alias("via")).join(adj.select(F.col("i").alias("via"), "j"), "via").where("i <> j").select("i", "j").distinct()
        for known in rounds[-2:]:
            step = step.join(known.select("i", "j"), ["i", "j"], "left_anti")
        rounds.append(cut(step.select("i", "j", F.lit(d).alias("d"))))
    found = rounds[0]
    for r in rounds[1:-1]:
        found = found.union(r)
    return found


def neighbourhood_function(ids: DataFrame, edges: DataFrame, lg_k: int = 12) -> list[int]:
    """For each number of hops from 0 on the estimated number of ordered pairs within it, until no more come.

    Each node keeps a HyperLogLog sketch of the nodes that it reaches, of 2**lg_k cells, and takes those of its neighbours each round: rows and work are in proportion
    to the edges, and a hub's sketches are merged before the shuffle.  The standard error of a node's number is about 1.04 / sqrt(2**lg_k).
    """
    links = cut(both_ways(edges).select("i", "j").union(ids.select(F.col("id").alias("i"), F.col("id").alias("j"))))
    reached = cut(ids.select(F.col("id").alias("j")).groupBy("j").agg(F.hll_sketch_agg("j", lg_k).alias("sketch")))
    found: list[int] = []
    while True:
        found.append(reached.agg(F.coalesce(F.sum(F.hll_sketch_estimate("sketch")), F.lit(0))).first()[0])
        if len(found) > 1 and found[-1] <= found[-2]:
            return found[:-1]
        reached = cut(links.join(reached, "j").groupBy("i").agg(F.hll_union_agg("sketch").alias("sketch")).withColumnRenamed("i", "j"))


def average_path_length(ids: DataFrame, edges: DataFrame, lg_k: int | None = None) -> DataFrame:
    """One row: the mean distance of connected pairs; with lg_k an estimate from sketches (see neighbourhood_function), else from all pairs.

    Dense graphs have bitmaps of what each node reaches, which are exact, and less work than sketches that go along each edge.
    """
    if (dense := bitmaps.pack(ids, edges)) is not None:
        many = bitmaps.distances(dense)
        return ids.sparkSession.range(1).select(F.lit(sum(d * k for d, k in enumerate(many, 1)) / sum(many)).alias("average_path_length"))
    if lg_k is None:
        return path_lengths(ids, edges).agg(F.avg("d").alias("average_path_length"))
    within = neighbourhood_function(ids, edges, lg_k)
    pairs = within[-1] - within[0] if within else 0
    mean = sum(t * (b - a) for t, (a, b) in enumerate(zip(within, within[1:], strict=False), 1)) / pairs if pairs else None
    name = F.lit(mean).cast("double").alias("average_path_length", metadata={"estimate": True, "relative_error": 1.04 / 2 ** (lg_k / 2)})
    return ids.sparkSession.range(1).select(name)
