"""Centroid clustering of vectors: Lloyd's rounds on distinct quantised vectors with their multiplicities.

A vector's components become whole numbers, so sums, means and squared distances are exact and neither partitioning nor the
order of rows matters.  Equal quantised vectors are one row with a weight from the first shuffle on, counted on the map side, so
a vector that a third of all rows have is one row of the rounds.  A round assigns the distinct vectors in Arrow batches by
matrix products and adds up weighted sums for each cluster within a task; a row for each cluster and task meets the others, and
one for each cluster comes to the driver, which has the centroids only.  Last, assignments are joined back to the rows by 128 bits of
hashes; vectors of very many rows are broadcast for that, of which there are a few for each partition at most.

Defined results: a vector that is null, has another number of components, or one that is null, not finite or beyond 2**27 after scaling
(where squared distances no longer fit a long) is left out; rows with equal vec_id are vectors of their own; a null vec_id
is the last of the seeds; seeds with equal hash go by their components; with fewer vectors than clusters there are fewer clusters; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, joined_by_weight, narrow_batches, table

#: Largest component, in which squared distances of 64 components fit a long.
MOST = 1 << 27
#: Components up to which products are exact as doubles.
EXACT = 1 << 22
#: Vectors compared at once.
STEP = 1 << 13


def quantised(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, q): whole components of the vectors that are kept."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(MOST) / scale))
    return vectors.where(F.coalesce((F.size("embedding") == size) & finite, F.lit(False))).select("vec_id", F.transform(whole, lambda x: x.cast("int")).alias("q"))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids: vectors of the k smallest hashes of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(order.alias("order"), "q").orderBy(F.col("order").asc_nulls_last(), "q").limit(k)
    return np.array([r.q for r in sorted(first.collect(), key=lambda r: (r.order is None, r.order, r.q))], dtype=np.int64)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of v; the smaller number if equal."""
    cluster, distance = np.empty(len(v), dtype=np.int64), np.empty(len(v), dtype=np.int64)
    small = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) <= EXACT
    step = STEP if small else STEP // 64
    for a in range(0, len(v), step):
        x = v[a : a + step]
        if small:  # all terms are whole numbers below 2**53
            f, g = x.astype(np.float64), c.astype(np.float64)
            d = ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)[None]).astype(np.int64)
        else:
            d = ((x[:, None] - c[None]) ** 2).sum(2)
        cluster[a : a + step] = d.argmin(1)
        distance[a : a + step] = d[np.arange(len(x)), cluster[a : a + step]]
    return cluster, distance


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _summed(c: np.ndarray):
    """Rows (cluster, n, sums): weighted sums of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
        for b in batches:
            v, w = _vectors(b.column(0), c.shape[1]), b.column(1).to_numpy()
            cluster, _ = nearest(v, c)
            np.add.at(n, cluster, w)
            np.add.at(sums, cluster, v * w[:, None])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = nearest(_vectors(b.column(0), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["q", "w", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay."""
    parts = distinct.mapInArrow(_summed(c), "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(c.shape[1])])
    out = c.copy()
    for r in total.collect():  # a row for each cluster
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def _key(q: Column) -> list[Column]:
    return [F.xxhash64(q).alias("a"), F.xxhash64(F.lit(1), q).alias("b")]


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """Per vector of vectors(vec_id, embedding) that is kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, cluster_size, copies."""
    spark = vectors.sparkSession
    narrow_batches(spark)
    rows = quantised(vectors, size, scale)
    distinct = cut(rows.groupBy("q").agg(F.count(F.lit(1)).alias("w")))
    c = seeds(rows, k, seed).reshape(-1, size)
    for _ in range(rounds if len(c) else 0):
        c = moved(distinct, c)
    if not len(c):
        assigned = distinct.select("q", "w", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        assigned = distinct.mapInArrow(_assigned(c), "q array<int>, w long, cluster int, distance long")
    assigned = cut(assigned.select(*_key(F.col("q")), "w", "cluster", "distance"))
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("w") * F.col("distance")).alias("cluster_inertia"), F.sum("w").alias("cluster_size")).collect()  # a row for each cluster
    inertia = sum(r.cluster_inertia for r in by_cluster)
    told = [(r.cluster, r.cluster_inertia, inertia, centroid_digest(c[r.cluster]), r.cluster_size) for r in by_cluster]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    back = joined_by_weight(rows.select("vec_id", *_key(F.col("q"))), assigned, ["a", "b"], "w")
    return back.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size", F.col("w").alias("copies"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """Each round as joins of long tables (vector, component) and (centroid, component)."""
    sql = f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) < 524288)) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS x FROM e),
s0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM e ORDER BY c LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(q) AS y FROM s0)"""
    for t in range(rounds + 1):
        sql += f""",
d{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM v JOIN c{t} USING (i) GROUP BY r, c) GROUP BY r)"""
        if t < rounds:
            sql += f""",
m{t} AS (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM d{t} JOIN v USING (r) GROUP BY best.c, i),
c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), y) AS y FROM c{t} LEFT JOIN m{t} USING (c, i))"""
    return f"""{sql},
h AS (SELECT c, sha256(string_agg(y, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
a AS (SELECT e.vec_id, e.q, best.c AS c, best.d AS d FROM d{rounds} JOIN e USING (r))
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256,
  count(*) OVER (PARTITION BY c) AS cluster_size, count(*) OVER (PARTITION BY q) AS copies FROM a JOIN h USING (c)"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLES = {"op11_centroid_clustering": _oracle()}
