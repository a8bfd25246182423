"""Edges that are asked for pair by pair: hashes side by side are those of expr.hash_uniform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from netmoment.functions import digests
from netmoment.functions import expr as E
from netmoment.operators import sampling
from netmoment.plans.model import Ensemble


def test_numbers_side_by_side():
    """Of all lengths of prefixes and numbers, negative and long ones included: equal to the bit, as nothing lies between a number and the next."""
    rng = np.random.default_rng(1)
    ids = np.unique(np.concatenate([rng.integers(0, 10**k, 20) for k in range(1, 19)] + [-rng.integers(1, 10**6, 20)]))
    for prefix in ("1:", "42:", "42:7:", "42:3:12:", "12345678901:123456789012345678:1:", "1" * 50 + ":"):
        for e in digests.endings(ids):
            u = np.array([digests.uniform(f"{prefix}{x}") for x in e.numbers])
            assert not digests.below(prefix, e, 0, u).any() and digests.below(prefix, e, 1, np.nextafter(u[1:], 1)).all()


def test_pairs_are_asked_in_blocks(spark, monkeypatch):
    """The edges of each pair's own hash, for ids of several lengths and blocks; no plan has a row for a pair."""
    monkeypatch.setattr(sampling, "ASKED", 40)
    monkeypatch.setattr(sampling, "IN_A_BATCH", 100)
    m = Ensemble.heterogeneous(spark.range(130).select((F.col("id") * F.col("id") - 50).alias("id"), (F.col("id") / 60 - 2).alias("mu")))
    a, b = (m.all_nodes.select(F.col("id").alias(c), F.col("mu").alias(f"mu_{c}")) for c in ("src", "dst"))
    pairs = a.join(b, F.col("src") < F.col("dst")).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    p = E.probability(-(F.col("mu_src") + F.col("mu_dst")))
    want = {tuple(r) for r in pairs.where(E.hash_uniform(9, F.col("src"), F.col("dst")) < p).select("src", "dst").collect()}
    twice = [tuple(r) for r in pairs.where(E.hash_uniform(9, F.col("rep"), F.col("src"), F.col("dst")) < p).select("rep", "src", "dst").collect()]
    one, two = sampling.sample_edges(m, 9), sampling.sample_edges(m, 9, 2)
    assert "md5" not in one._jdf.queryExecution().toString()
    assert sorted(map(tuple, one.collect())) == sorted(want)
    assert sorted(map(tuple, two.collect())) == sorted(twice)
    degrees: dict[int, int] = {}
    for _, i, j in twice:
        degrees[i], degrees[j] = degrees.get(i, 0) + 1, degrees.get(j, 0) + 1
    assert {r.id: r.total for r in sampling.sample_degrees(m, 9, 2).collect()} == degrees
    flat = Ensemble.homogeneous(spark, 50, -1.0)
    assert {tuple(r) for r in sampling.sample_edges(flat, 3).collect()} == {(i, j) for i in range(50) for j in range(i + 1, 50) if digests.uniform(f"3:{i}:{j}") < flat.p}
