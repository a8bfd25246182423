"""Nodes and edges as DataFrames: nodes(id, mu), edges(src, dst) with src < dst."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_count, block_of, paired


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(df: DataFrame, id_: str, mu: str) -> DataFrame:
    """nodes(id, mu) from expressions over df."""
    return df.select(F.expr(id_).cast("long").alias("id"), F.expr(mu).cast("double").alias("mu"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: src < dst, once each, no loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(i, j) for either direction of each edge."""
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).union(edges.select(F.col("dst").alias("i"), F.col("src").alias("j")))


def from_pairs(spark: SparkSession, pairs: Iterable[tuple[int, int]]) -> DataFrame:
    pairs = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
    return _from_arrays(spark, pairs[:, 0], pairs[:, 1])


def _from_arrays(spark: SparkSession, src: np.ndarray, dst: np.ndarray) -> DataFrame:
    """Whole arrays at once, rather than a row for each cell."""
    return canonical(spark.createDataFrame(pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})))


def from_matrix(spark: SparkSession, rows: Any, n: int | None = None) -> DataFrame:
    """Edges of a square adjacency matrix that the driver holds: nested lists, an array, or a scipy sparse matrix."""
    if hasattr(rows, "tocoo"):
        coo = rows.tocoo()
        shape, (src, dst) = coo.shape, (x[np.asarray(coo.data) != 0] for x in (np.asarray(coo.row), np.asarray(coo.col)))
    else:
        rows = [np.asarray(r) for r in rows]
        shape = (len(rows), max((len(r) for r in rows), default=0))
        found = [np.flatnonzero(r) for r in rows]
        src, dst = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    if shape[0] != shape[1] or (n is not None and shape[0] != n):
        raise ValueError(f"expected a square matrix{'' if n is None else f' of {n} nodes'}, got shape {shape}")
    return _from_arrays(spark, src, dst)


def from_matrix_rows(rows: DataFrame) -> DataFrame:
    """Edges of a distributed adjacency matrix rows(i, values): a row's values, zero where there is no edge."""
    cells = rows.select(F.col("i").alias("src"), F.posexplode("values").alias("dst", "value"))
    return canonical(cells.where("value <> 0").select("src", "dst"))


def from_graph(spark: SparkSession, graph: Any, n: int | None = None) -> DataFrame:
    """Edges of a networkx or igraph graph, undirected and with nodes numbered from 0."""
    if hasattr(graph, "get_edgelist"):
        directed, size, pairs = graph.is_directed(), graph.vcount(), graph.get_edgelist()
    else:
        directed, size = graph.is_directed(), graph.number_of_nodes()
        place = {v: k for k, v in enumerate(graph.nodes())}
        pairs = [(place[u], place[v]) for u, v in graph.edges()]
    if directed:
        raise ValueError("expected an undirected graph")
    if n is not None and size != n:
        raise ValueError(f"expected {n} nodes, got {size}")
    return from_pairs(spark, pairs)


#: Pairs of entries that are counted in one go.
AT_ONCE = 1 << 20


def _shared(u: np.ndarray, s: np.ndarray, v: np.ndarray, t: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Users of u and of v that share at least so many slots, of entries (u, s) and (v, t), each once."""
    (us, a), (vs, b) = (np.unique(x, return_inverse=True) for x in (u, v))
    by = np.argsort(t, kind="stable")
    t, b = t[by], b[by]
    low = np.searchsorted(t, s)
    many = np.searchsorted(t, s, side="right") - low
    upto = np.concatenate([[0], np.cumsum(many)])
    counts = np.zeros(len(us) * len(vs), dtype=np.int64)
    x = 0
    while x < len(s):
        y = max(x + 1, int(np.searchsorted(upto, upto[x] + AT_ONCE, side="right")) - 1)
        m = many[x:y]
        at = np.arange(int(m.sum())) + np.repeat(low[x:y] - (upto[x:y] - upto[x]), m)
        counts += np.bincount(np.repeat(a[x:y] * len(vs), m) + b[at], minlength=len(counts))
        x = y
    found = np.flatnonzero(counts >= max(least, 1))
    return us[found // len(vs)], vs[found % len(vs)]


def edges_by_slots(events: DataFrame, least: int) -> DataFrame:
    """Users that share at least so many (hour, event type) slots.

    Users are dealt out in blocks, with their slots as hashes of 64 bits; a task counts what each two users of two blocks share, so a table is shuffled but no pair of its rows.
    """
    slots = events.select(F.col("user_id").cast("long").alias("u"), F.date_trunc("hour", "ts").alias("h"), "event_type").dropna().select("u", F.xxhash64("h", "event_type").alias("s")).distinct()
    n = block_count(events.agg(F.count_distinct(F.col("user_id").cast("long"))).first()[0])
    a, b = (slots.groupBy(block_of("u", n).alias(f"block_{k}")).agg(F.collect_list("u").alias(f"u_{k}"), F.collect_list("s").alias(f"s_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, u, s, m, v, t in zip(*batch.columns, strict=True):
                src, dst = _shared(*(x.values.to_numpy() for x in (u, s, v, t)), least)
                if k.as_py() == m.as_py():
                    once = src < dst
                    src, dst = src[once], dst[once]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], names=["src", "dst"])

    return paired(a, b, n, n, F.col("block_a") <= F.col("block_b")).mapInArrow(run, "src long, dst long")


# Sinks


def to_networkx(edges: DataFrame, ids: DataFrame) -> Any:
    """A networkx graph; needs networkx, and a graph that fits the driver."""
    import networkx as nx

    g = nx.Graph()
    g.add_nodes_from(r.id for r in ids.select("id").toLocalIterator())
    g.add_edges_from((r.src, r.dst) for r in edges.toLocalIterator())
    return g


def to_igraph(edges: DataFrame, n: int) -> Any:
    """An igraph graph of ids 0 to n-1; needs igraph, and a graph that fits the driver."""
    import igraph

    return igraph.Graph(n=n, edges=[(r.src, r.dst) for r in edges.toLocalIterator()])


def to_sparse(edges: DataFrame, n: int) -> Any:
    """A symmetric scipy CSR matrix of ids 0 to n-1; needs scipy, and a graph that fits the driver."""
    from scipy.sparse import csr_matrix

    t = edges.select("src", "dst").toArrow()
    src, dst = (t[c].to_numpy() for c in ("src", "dst"))
    return csr_matrix((np.ones(2 * len(src), dtype=np.int8), (np.concatenate([src, dst]), np.concatenate([dst, src]))), shape=(n, n))


def write_results(results: DataFrame, path: str, *keys: str) -> None:
    """Results as Parquet, in a folder for each value of the keys; what is there is replaced."""
    results.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
