"""op11: centroid clustering against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from netmoment.llm import centroids
from tests.conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, size, scale=256):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == size and all(x is not None and abs(x) < centroids.MOST / scale for x in e):
            kept.append((vec_id, [int(np.floor(scale * float(np.float32(x)))) for x in e]))
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in seeds[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for i in range(len(c)):
            if members := [q for (_, q), o in zip(kept, own, strict=True) if o == i]:
                c[i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(v, *near(q)[::-1]) for v, q in kept]
    total = sum(d for *_, d in found)
    return sorted(str((v, i, d, sum(y for _, x, y in found if x == i), total, hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest())) for v, i, d in found)


def got(df, k, rounds, size):
    out = centroids.clustered(df, k, rounds, size)
    return sorted(str(tuple(r)) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("copies", [0, 60])
def test_as_plain_loops(spark, copies):
    rng = random.Random(copies)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(90)]
    rows += [(1000 + i, rows[3][1]) for i in range(copies)]  # a hot vector
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    assert got(df, 7, 3, 6) == plain(rows, 7, 3, 6)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, inf]), (5, [nan, 1.0]), (6, [0.5]), (7, [-0.001, 0.001]), (7, [-0.001, 0.001]), (7, [3.0, 4.0]), (None, [1.0, 1.0]), (8, [5e5, -5e5]), (9, [1e30, 0.0]), (10, [-1.5, 2.5])]
    want = plain([r for r in rows if r[1] is None or not any(x != x for x in r[1] if x is not None)], 4, 2, 2)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert got(df, 4, 2, 2) == want and len(want) == 6
    clash = df.selectExpr("*", "1 as q", "2 as w", "3 as cluster", "4 as distance", "5 as a", "6 as b", "7 as hot", "8 as n", "9 as copies")
    assert got(clash, 4, 2, 2) == want
    assert len(got(df, 100, 2, 2)) == 6  # fewer vectors than clusters


def test_empty(spark):
    out = centroids.clustered(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-(2**27), 2**27, (50, 64)), rng.integers(-(2**27), 2**27, (5, 64))
    cluster, distance = centroids.nearest(v, c)
    for x, i, d in zip(v.tolist(), cluster, distance, strict=True):
        assert min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c.tolist())) == (d, i)


def test_same_as_sql(same_as_sql):
    same_as_sql(centroids.op11_centroid_clustering, centroids.ORACLES["op11_centroid_clustering"])


def test_partitions_do_not_matter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert rows_of(centroids.clustered(df.repartition(13)).toPandas()) == rows_of(centroids.clustered(df.coalesce(1)).toPandas())
