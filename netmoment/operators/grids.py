"""Parameter grids, means over replicates, and how far estimates are from exact values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def product(spark: SparkSession, **axes: list) -> DataFrame:
    """One row for each combination of the axes' values."""
    out = None
    for name, values in axes.items():
        kind = "double" if any(isinstance(v, float) for v in values) else "boolean" if all(isinstance(v, bool) for v in values) else "string" if any(isinstance(v, str) for v in values) else "long"
        axis = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out


def simulate(grid: DataFrame, replicates: int, run: Callable[[dict], dict], schema: str) -> DataFrame:
    """run() of each grid row and replicate (its key rep), spread over tasks; schema is that of the results."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([run(r) for r in part.to_dict("records")])

    each = grid.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return each.repartition(grid.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(rows, schema)


def group_mean(runs: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(value).alias(name or value), F.count(F.lit(1)).alias("reps"))


def error_metrics(df: DataFrame, exact: str, other: str) -> DataFrame:
    """One row: relative error in norm, correlation and its square."""
    e, x = F.col(exact), F.col(other)
    got = df.agg(F.sqrt(F.try_divide(F.sum((e - x) * (e - x)), F.sum(e * e))).alias("error"), F.corr(exact, other).alias("correlation"))
    return got.select("error", "correlation", (F.col("correlation") * F.col("correlation")).alias("r2"))
