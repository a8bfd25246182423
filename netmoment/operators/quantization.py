"""Nodes with several parameters merged into units: by rounding each parameter, or by a codebook that k-means learns.

A unit has the means of its nodes' parameters and their number as its weight; what is computed for units goes back to their nodes by code, and
materialized() gives each node its unit's parameters, so that models have as many classes as there are units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Ensemble
from ..sources.checkpoints import cut


@dataclass(frozen=True)
class Quantized:
    """codes(id, code) of nodes, and units(code, columns, w)."""

    codes: DataFrame
    units: DataFrame
    columns: tuple[str, ...]

    def materialized(self) -> DataFrame:
        """(id, columns): nodes with the parameters of their units."""
        return self.dequantized(self.units.select("code", *self.columns))

    def dequantized(self, values: DataFrame) -> DataFrame:
        """(id, …): each node with the other columns of values(code, …) of its unit."""
        return self.codes.join(values, "code").select("id", *[c for c in values.columns if c != "code"])

    def ensemble(self, mu: str = "mu") -> Ensemble:
        """The model of the units' mu."""
        return Ensemble.heterogeneous(self.materialized().select("id", F.col(mu).alias("mu")))

    def error(self, nodes: DataFrame) -> DataFrame:
        """One row (error): the mean squared distance of nodes(id, columns) from their units."""
        units = self.materialized().select("id", *[F.col(c).alias(f"{c}_unit") for c in self.columns])
        off = [(F.col(c) - F.col(f"{c}_unit")) * (F.col(c) - F.col(f"{c}_unit")) for c in self.columns]
        return nodes.join(units, "id").agg(F.avg(sum(off[1:], off[0])).alias("error"))


def _merged(coded: DataFrame, columns: tuple[str, ...]) -> Quantized:
    """Units of coded(id, code, columns)."""
    coded = cut(coded)
    units = coded.groupBy("code").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("w"))
    return Quantized(coded.select("id", "code"), units, columns)


def rounded(nodes: DataFrame, digits: dict[str, int]) -> Quantized:
    """Units of nodes(id, …) whose parameters all round alike, each to its own number of digits."""
    if not digits:
        raise ValueError("there must be parameters to round")
    code: Column = F.concat_ws("/", *[F.round(c, n).cast("string") for c, n in digits.items()])
    return _merged(nodes.select("id", code.alias("code"), *digits), tuple(digits))


def codebook(nodes: DataFrame, columns: tuple[str, ...], k: int, seed: int = 0, steps: int = 20) -> Quantized:
    """At most k units of nodes(id, columns) that k-means finds, parameters scaled to unit variance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    if k <= 0:
        raise ValueError("a codebook needs codes")
    named = nodes.select("id", *columns)
    if k == 1:
        return _merged(named.withColumn("code", F.lit("0")), tuple(columns))
    features = VectorAssembler(inputCols=list(columns), outputCol="features_").transform(named)
    scaled = cut(StandardScaler(inputCol="features_", outputCol="scaled_").fit(features).transform(features).drop("features_"))
    model = KMeans(k=k, seed=seed, maxIter=steps, featuresCol="scaled_", predictionCol="code").fit(scaled)
    return _merged(model.transform(scaled).select("id", F.col("code").cast("string").alias("code"), *columns), tuple(columns))
